"""Raw log lines from text files, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilark.operators.parse import strip

PHASE_MARK = "# === PHASE"


def scan_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Trimmed non-blank lines of every file below ``folder``, with path and block start.

    Invalid UTF-8 is replaced while decoding; lines are split by Hadoop input
    splits, so one huge file is still read in parallel.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(folder)
    return lines.select(
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        strip("value").alias("line"),
    ).filter(F.length("line") > 0)


def stream_lines(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """The same lines as an unbounded feed; new data must arrive as new files."""
    lines = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files).text(folder)
    )
    return lines.select(
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        strip("value").alias("line"),
    ).filter(F.length("line") > 0)


def scan_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """(source_path, line_no, line) with line numbers from 0, for files of any size.

    A file is read in input splits. A line's number is its place in its split and the lines of the splits
    before it, whose counts are summed up per file: one row for each split.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(folder)
    # Rows of a split come in their order, one after another, so their ids count up without a gap.
    placed = lines.select(
        F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    before = Window.partitionBy("source_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy("source_path", "split").agg(F.min("row").alias("first"), F.count("*").alias("n")).select(
        "source_path", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("lift"))
    return placed.join(splits, ["source_path", "split"]).select(
        "source_path", (F.col("row") + F.col("lift")).alias("line_no"), "line")


def label_phases(numbered: DataFrame, block_lines: int = 100_000) -> DataFrame:
    """Valid JSON lines with the phase named by the last section header before them.

    Lines are handled in blocks of line numbers; the header in force at the
    start of a block is carried over from the per-block last header, so a
    huge scenario is never ordered in one task.
    """
    text = strip("line")
    header = F.when(text.startswith(PHASE_MARK), F.trim(F.get(F.split(text, "==="), 1)))
    marked = numbered.withColumns({
        "text": text, "header": header,
        "block": F.floor(F.col("line_no") / block_lines)})
    last_header = (
        marked.filter(F.col("header").isNotNull())
        .groupBy("source_path", "block").agg(F.max_by("header", "line_no").alias("block_last"))
    )
    every_block = marked.select("source_path", "block").distinct()
    by_file = Window.partitionBy("source_path").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = every_block.join(last_header, ["source_path", "block"], "left").withColumn(
        "carried", F.last("block_last", ignorenulls=True).over(by_file)).drop("block_last")
    inside = Window.partitionBy("source_path", "block").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, 0)
    is_json = F.try_parse_json(F.concat(F.lit("["), F.col("text"), F.lit("]"))).isNotNull()
    return (
        marked.withColumn("here", F.last("header", ignorenulls=True).over(inside))
        .join(carried, ["source_path", "block"], "left")
        .withColumn("phase", F.coalesce("here", "carried", F.lit("")))
        .filter((F.length("text") > 0) & ~F.col("text").startswith("#") & is_json)
        .select("source_path", "line_no", "phase", F.col("text").alias("line"))
    )
