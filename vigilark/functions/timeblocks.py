"""Sliding-window building blocks that hold up when one key has most of the rows.

A plain window partitioned by an address or host puts every row of a popular
key into one task. These helpers shrink the input first (one row per key and
second) and then cut each key's time line into blocks, so a task sees at most
one block of one key whatever the number of rows behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark.session import checkpoint


def epoch(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a TIMESTAMP column."""
    return F.floor(F.unix_micros(ts) / 1_000_000).cast("bigint")


def with_halo(rows: DataFrame, second: str, reach: int, block: int) -> DataFrame:
    """Put each row in its own time block and, marked ``halo``, in the next block it can reach."""
    if block < reach:
        raise ValueError("a block must be at least as long as the window")
    own = F.floor(F.col(second) / block)
    reached = F.floor((F.col(second) + reach) / block)
    blocks = F.when(reached > own, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.select("*", F.posexplode(blocks).alias("halo", "time_block")).withColumn(
        "halo", F.col("halo") > 0)


def sliding_count(rows: DataFrame, keys: list[str], second: str, width: int) -> DataFrame:
    """(keys, second, n, n_in_window): rows in ``[second - width, second]`` per key."""
    return sliding_sum(rows.groupBy(*keys, second).agg(F.count("*").alias("n")), keys, second, width)


def sliding_sum(per_second: DataFrame, keys: list[str], second: str, width: int) -> DataFrame:
    """:func:`sliding_count` from the counts ``n`` of each key and second."""
    block = max(width, 86_400)
    frame = (Window.partitionBy(*keys, "time_block").orderBy(second).rangeBetween(-width, 0))
    return (
        with_halo(per_second, second, width, block)
        .withColumn("n_in_window", F.sum("n").over(frame))
        .filter(~F.col("halo")).drop("halo", "time_block")
    )


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], second: str,
                  reach: int) -> DataFrame:
    """Per distinct (keys, second) of ``left``: the last ``right`` second within ``reach`` before.

    Both sides become one row per key and second; the result is an as-of
    match without a range join.
    """
    marks = (
        left.select(*keys, second, F.lit(True).alias("asks"), F.lit(False).alias("answers"))
        .unionByName(right.select(*keys, second, F.lit(False).alias("asks"),
                                  F.lit(True).alias("answers")))
        .groupBy(*keys, second).agg(F.max("asks").alias("asks"), F.max("answers").alias("answers"))
    )
    frame = (Window.partitionBy(*keys, "time_block").orderBy(second)
             .rangeBetween(-reach, 0))
    return (
        with_halo(marks, second, reach, max(reach, 86_400))
        .withColumn("matched_second", F.max(F.when(F.col("answers"), F.col(second))).over(frame))
        .filter(F.col("asks") & ~F.col("halo") & F.col("matched_second").isNotNull())
        .select(*keys, second, "matched_second")
    )


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column,
                name: str) -> DataFrame:
    """Exact running total of ``value`` per key, this row included, for keys of any size.

    The rows are range-partitioned by key and order, summed inside each
    partition, and lifted by the key's total in the partitions before it. The
    partitioned rows are checkpointed so that both uses see the same cut.
    ``order`` must be unique per key for a repeatable result.
    """
    cut = checkpoint(
        rows.withColumn("_value", value).repartitionByRange(*keys, *order)
        .withColumn("_part", F.spark_partition_id()))
    # One row per key and partition it touches; a key inside one partition needs no offset.
    per_part = cut.groupBy(*keys, "_part").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        per_part.withColumn("_before", F.sum("_total").over(earlier))
        .filter(F.col("_before").isNotNull()).drop("_total")
    )
    local = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_local", F.sum("_value").over(local))
        .join(offsets, [*keys, "_part"], "left")
        .withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0)))
        .drop("_part", "_local", "_before", "_value")
    )
