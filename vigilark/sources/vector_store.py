"""The vector table: build, upsert, insert-if-absent and tiering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilark import dims


def vector_records(rows: DataFrame) -> DataFrame:
    """Vector rows of canonical rows that have a sentence; empty metadata becomes null."""
    kept = rows.filter(F.length(F.trim("synthetic_intent")) > 0)
    return kept.select(
        F.col("log_uuid").alias("id"), F.col("synthetic_intent").alias("document"),
        (F.unix_micros("event_timestamp") / 1e6).alias("event_epoch"), "event_type", "hostname",
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("source_ip", "dest_ip")])


def record_counts(rows: DataFrame) -> DataFrame:
    """{ingested, skipped} of a batch."""
    has_text = F.length(F.trim(F.coalesce("synthetic_intent", F.lit("")))) > 0
    return rows.agg(F.count_if(has_text).alias("ingested"), F.count_if(~has_text).alias("skipped"))


def latest_per_id(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per id, the last by ``order``; an aggregate, so copies combine before the shuffle."""
    rest = [c for c in rows.columns if c != "id"]
    return (
        rows.groupBy("id")
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select("id", "row.*")
    )


def upsert(target: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """The target with the batch's rows put in by id; the last write wins."""
    fresh = latest_per_id(batch, order)
    return target.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def insert_absent(target: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """The target plus the batch's rows with new ids; the first of several new rows wins."""
    rest = [c for c in batch.columns if c != "id"]
    new = batch.join(target.select("id"), "id", "left_anti")
    first = new.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return target.unionByName(first.select("id", "row.*"))


def split_tiers(active: DataFrame, now_epoch: float, hot_s: int = dims.HOT_WINDOW_S,
                per_pass: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay hot, rows that move to the archive).

    ``per_pass`` moves only the oldest rows of a pass; the rest stay for the next.
    """
    old = F.col("event_epoch") < now_epoch - hot_s
    if per_pass is None:
        return active.filter(~old), active.filter(old)
    moving = active.filter(old).orderBy("event_epoch", "id").limit(per_pass)
    return active.join(moving.select("id"), "id", "left_anti"), moving


def migrate(active: DataFrame, archive: DataFrame, now_epoch: float,
            hot_s: int = dims.HOT_WINDOW_S, per_pass: int | None = None
            ) -> tuple[DataFrame, DataFrame]:
    """(hot table, archive table) after moving the old rows over."""
    stay, move = split_tiers(active, now_epoch, hot_s, per_pass)
    return stay, upsert(archive, move, ["event_epoch"])


def tier_stats(active: DataFrame, archive: DataFrame) -> DataFrame:
    tiers = active.select(F.lit("active").alias("tier")).unionByName(
        archive.select(F.lit("archive").alias("tier")))
    return tiers.groupBy("tier").agg(F.count("*").alias("n_rows"))
