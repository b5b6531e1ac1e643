"""The canonical archive: date-partitioned Parquet, written by append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_archive(rows: DataFrame, path: str) -> None:
    """Append canonical rows below ``event_date=...``.

    The rebalance hint keeps a quiet day in one task, so in one file, and splits a busy
    day over many by size; inside a file rows are sorted by address and process so
    that min/max statistics can skip row groups.
    """
    (
        rows.withColumn("event_date", F.to_date("event_timestamp"))
        .hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "source_ip", "process_name")
        .write.mode("append").partitionBy("event_date").parquet(path)
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(archive: DataFrame, start: str, end: str, source_ip: str | None = None,
           process_name: str | None = None) -> DataFrame:
    """Rows in a time range; the date bound prunes folders, the rest is pushed to the scan."""
    found = archive.filter(
        F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & F.col("event_timestamp").between(F.lit(start).cast("timestamp"),
                                           F.lit(end).cast("timestamp")))
    if source_ip is not None:
        found = found.filter(F.col("source_ip") == source_ip)
    if process_name is not None:
        found = found.filter(F.col("process_name") == process_name)
    return found


def lookup_uuids(archive: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the archive named by a frame of ``log_uuid``."""
    return archive.join(wanted.select("log_uuid").distinct(), "log_uuid", "left_semi")
