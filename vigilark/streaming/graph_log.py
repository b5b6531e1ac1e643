"""The entity graph of a stream as a log-structured table.

A batch appends one run: its contributions, reduced to a row per id, in buckets of ids. Nothing that is stored
is rewritten, so a batch writes in proportion to itself. Readers merge on read: what a bucket has in its base and
in the runs behind it. ``compact`` is a job of its own, which writes a new base for the buckets whose runs have
grown to a share of their base, and then says so in the manifest. A run counts once its batch is marked; a batch that
is replayed overwrites its own run, and batches that are merged are always marked ones.

Below the folder: ``nodes`` and ``edges``, each with ``runs/batch=N/bucket=B`` and ``base/version=V/bucket=B``,
``delta/v{N}``, ``manifest`` and ``versions``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.operators import graph
from vigilark.streaming.versions import last_version, mark_version

BUCKETS = 16
TABLES = ("nodes", "edges")
RUN = {
    "nodes": "id string, type string, label string, score double, first_seen timestamp, last_seen timestamp, touches bigint, "
             "first struct<seen_at:timestamp,origin:string>, bucket int, batch bigint",
    "edges": "id string, source string, target string, type string, mitre_technique_id string, timestamp timestamp, "
             "first struct<batch:bigint,seen_at:timestamp,origin:string>, bucket int, batch bigint",
}
BASE = {name: schema.removesuffix("batch bigint") + "version bigint" for name, schema in RUN.items()}
MANIFEST = "table string, bucket int, version bigint, upto bigint"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _node_run(parts: DataFrame) -> DataFrame:
    """A row per node id that can be merged with others: the sum is capped only when read."""
    first = F.struct("seen_at", "origin")
    return parts.groupBy("id").agg(
        F.min_by("type", first).alias("type"), F.min_by("label", first).alias("label"), F.sum("score").alias("score"),
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.sum("touches").alias("touches"),
        F.min(first).alias("first"))


def _edge_run(parts: DataFrame, batch_id: int) -> DataFrame:
    """A row per edge id: the first writer of the batch. Later batches never replace an edge, so the batch comes first."""
    order = F.struct(F.lit(batch_id).cast("bigint").alias("batch"), "seen_at", "origin")
    kept = F.struct("source", "target", "type", "mitre_technique_id", F.col("seen_at").alias("timestamp"))
    return parts.groupBy("id").agg(F.min_by(kept, order).alias("e"), F.min(order).alias("first")).select("id", "e.*", "first")


def _merged(table: str, rows: DataFrame, *keys: str) -> DataFrame:
    """A row per id; an id has one bucket, so ``keys`` only keep it."""
    if table == "nodes":
        return rows.groupBy("id", *keys).agg(
            F.min_by("type", "first").alias("type"), F.min_by("label", "first").alias("label"), F.sum("score").alias("score"),
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("touches").alias("touches"),
            F.min("first").alias("first"))
    kept = F.struct("source", "target", "type", "mitre_technique_id", "timestamp")
    return rows.groupBy("id", *keys).agg(F.min_by(kept, "first").alias("e"), F.min("first").alias("first")).select("id", *keys, "e.*", "first")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A partitioned table, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _manifest(spark: SparkSession, folder: str, table: str) -> dict[int, tuple[int, int]]:
    """Bucket to (base version, last batch in it): at most a row per bucket reaches the driver."""
    rows = _table(spark, f"{folder}/manifest", MANIFEST).filter(F.col("table") == table)
    return {r.bucket: (r.version, r.upto) for r in rows.groupBy("bucket").agg(
        F.max("version").alias("version"), F.max("upto").alias("upto")).collect()}


def _stored(spark: SparkSession, folder: str, table: str, before: int) -> tuple[DataFrame, DataFrame]:
    """(base rows, run rows behind them) of the marked batches older than ``before``."""
    held = _manifest(spark, folder, table)
    last = last_version(spark, folder, before)
    base = _table(spark, f"{folder}/{table}/base", BASE[table])
    current = reduce(or_, [(F.col("bucket") == b) & (F.col("version") == v) for b, (v, _) in held.items()], F.lit(False))
    upto = F.lit(-1)
    for b, (_, batch) in held.items():
        upto = F.when(F.col("bucket") == b, batch).otherwise(upto)
    runs = _table(spark, f"{folder}/{table}/runs", RUN[table]).filter(
        (F.col("batch") <= (-1 if last is None else last)) & (F.col("batch") > upto))
    return base.filter(current), runs


def _rows(spark: SparkSession, folder: str, table: str, before: int) -> DataFrame:
    base, runs = _stored(spark, folder, table, before)
    return _merged(table, base.drop("version", "bucket").unionByName(runs.drop("batch", "bucket")))


def nodes(spark: SparkSession, folder: str, before: int = 1 << 62) -> DataFrame:
    """The node table as :func:`graph.build_nodes` gives it, after all marked batches older than ``before``."""
    merged = _rows(spark, folder, "nodes", before)
    return graph.dress_nodes(merged.withColumn("threat_score", F.least(F.lit(100.0), F.col("score"))).drop("score", "first"))


def edges(spark: SparkSession, folder: str, before: int = 1 << 62) -> DataFrame:
    """The edge table as :func:`graph.build_edges` gives it."""
    return graph.dress_edges(_rows(spark, folder, "edges", before).drop("first"))


def _append(rows: DataFrame, folder: str, table: str, batch_id: int, buckets: int) -> None:
    placed = rows.withColumn("bucket", _bucket(buckets))
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{table}/runs/batch={batch_id}")


def updates(folder: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Batch handler: append the batch's run, and write what it changes as ``delta/v{batch_id}``.

    ``buckets`` stays the same for the life of a folder.
    """
    def update(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch.persist()
        node_parts, edge_parts = graph.log_node_parts(rows), graph.log_edge_parts(rows)
        known = []
        for table in TABLES:
            base, runs = _stored(spark, folder, table, batch_id)
            known.append(base.select("id").unionByName(runs.select("id")).distinct())
        graph.delta(known[0], known[1], node_parts, edge_parts).write.mode("overwrite").parquet(f"{folder}/delta/v{batch_id}")
        _append(_node_run(node_parts), folder, "nodes", batch_id, buckets)
        _append(_edge_run(edge_parts, batch_id), folder, "edges", batch_id, buckets)
        mark_version(spark, folder, batch_id)
        rows.unpersist()

    return update


def compact(spark: SparkSession, folder: str, share: float = 0.25) -> dict[str, list[int]]:
    """Merge the buckets whose runs have at least ``share`` of their base's rows; the buckets by table.

    Each row is so merged a number of times that grows with the logarithm of the table. One compaction runs at a time;
    batches may go on meanwhile.
    """
    done: dict[str, list[int]] = {}
    last = last_version(spark, folder, 1 << 62)
    for table in TABLES:
        base, runs = _stored(spark, folder, table, 1 << 62)
        sizes = runs.groupBy("bucket").agg(F.count("*").alias("n")).join(
            base.groupBy("bucket").agg(F.count("*").alias("held")), "bucket", "left")
        due = [r.bucket for r in sizes.filter(F.col("n") >= share * F.coalesce("held", F.lit(0))).collect()]
        done[table] = sorted(due)
        if not due:
            continue
        mine = F.col("bucket").isin(due)
        version = max([v for v, _ in _manifest(spark, folder, table).values()], default=0) + 1
        rows = base.filter(mine).drop("version").unionByName(runs.filter(mine).drop("batch"))
        buckets = spark.createDataFrame([(table, b, version, last) for b in due], MANIFEST)
        _merged(table, rows, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{table}/base/version={version}")
        # One file, written last: until then readers see the old base and its runs.
        buckets.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return done
