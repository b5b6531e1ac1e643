"""Priority order, load shedding and queue counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilark import dims


def next_items(rows: DataFrame, n: int) -> DataFrame:
    """The next ``n`` rows to work on: most urgent first, then oldest."""
    return rows.orderBy("priority", "event_timestamp", "log_uuid").limit(n)


def shed_load(rows: DataFrame, drain: str = "5 seconds",
              max_depth: int = dims.QUEUE_MAX_DEPTH) -> DataFrame:
    """Mark P2 rows that arrive once ``max_depth`` rows of their drain window are queued.

    Every other row is queued at any depth, so depth only grows between
    drains and a row sees a full queue exactly when it arrives after the
    window's ``max_depth``-th row. Only that row is looked up: Spark keeps
    the first rows per window on the map side, and the full window is never
    sorted in one place.
    """
    windowed = rows.withColumn("drain", F.window("event_timestamp", drain)["start"])
    arrival = Window.partitionBy("drain").orderBy("event_timestamp", "log_uuid")
    full_at = (
        windowed.select("drain", "event_timestamp", "log_uuid")
        .withColumn("rank", F.row_number().over(arrival)).filter(F.col("rank") <= max_depth)
        .groupBy("drain")
        .agg(F.max(F.struct("event_timestamp", "log_uuid")).alias("last"),
             F.count("*").alias("queued"))
        .filter(F.col("queued") == max_depth).select("drain", "last")
    )
    late = F.struct("event_timestamp", "log_uuid") > F.col("last")
    return (
        windowed.join(full_at, "drain", "left")
        .withColumn("dropped", F.coalesce(late & (F.col("severity") == "P2"), F.lit(False)))
        .drop("last")
    )


def queue_stats(shed: DataFrame, max_depth: int = dims.QUEUE_MAX_DEPTH) -> DataFrame:
    """Enqueued and dropped rows, and the deepest queue of any drain window."""
    per_drain = shed.groupBy("drain").agg(
        F.count_if(~F.col("dropped")).alias("kept"), F.count_if("dropped").alias("lost"))
    return per_drain.agg(
        F.max("kept").alias("depth"), F.sum("kept").alias("total_enqueued"),
        F.sum("lost").alias("total_dropped"), F.lit(max_depth).alias("max_depth"))
