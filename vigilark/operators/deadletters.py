"""The dead-letter table: append, retry, escalate, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.fields import to_time


def dead_letters(rows: DataFrame, work_type: str, reason: Column, payload: list[str],
                 failed_at: Column, row_id: str = "log_uuid") -> DataFrame:
    """Dead-letter rows of failed work.

    The id follows from ``row_id`` and the payload: a retried job adds nothing new, and two
    rows with one payload stay two letters.
    """
    body = F.to_json(F.struct(*payload))
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(work_type), F.col(row_id).cast("string"), body), 256).alias("dlq_uuid"),
        F.lit(work_type).alias("work_type"), body.alias("payload"),
        reason.alias("failure_reason"), failed_at.alias("failed_at"),
        F.lit(0).alias("retry_count"), F.lit(False).alias("resolved"))


def append_dead_letters(letters: DataFrame, path: str) -> None:
    letters.write.mode("append").parquet(path)


def _eligible(now: Column, max_retries: int, min_age_s: int) -> Column:
    """Unresolved, retries left, old enough; an unreadable failure time counts as old."""
    failed = to_time(F.col("failed_at"))
    age_us = F.unix_micros(now) - F.unix_micros(failed)
    return ((F.col("retry_count") < max_retries) & ~F.col("resolved")
            & F.coalesce(age_us >= min_age_s * 1_000_000, F.lit(True)))


def eligible(letters: DataFrame, now: Column, max_retries: int = dims.DEAD_LETTER_MAX_RETRIES,
             min_age_s: int = dims.DEAD_LETTER_MIN_AGE_S) -> DataFrame:
    return letters.filter(_eligible(now, max_retries, min_age_s))


def _rebuildable() -> Column:
    """The payload is a JSON object that names a known event type, or none."""
    fields = F.try_parse_json("payload").try_cast("map<string,string>")
    kind = F.when(F.map_contains_key(fields, "event_type"), fields["event_type"]).otherwise("UNKNOWN")
    return F.coalesce(fields.isNotNull() & kind.isin(*dims.EVENT_TYPES), F.lit(False))


def resubmissions(picked: DataFrame) -> DataFrame:
    """Minimal canonical rows rebuilt from the payload, to be queued at P1.

    A payload that is no JSON object or names an unknown event type gives no row.
    """
    fields = F.try_parse_json("payload").try_cast("map<string,string>")

    def get(name: str, default: Column | str) -> Column:
        default = F.lit(default) if isinstance(default, str) else default
        return F.when(F.map_contains_key("f", name), F.col("f")[name]).otherwise(default).alias(name)

    rows = picked.filter(_rebuildable()).withColumn("f", fields).select(
        "dlq_uuid", get("log_uuid", F.col("dlq_uuid")), get("event_timestamp", ""),
        get("event_type", "UNKNOWN"), get("hostname", "unknown"),
        get("sha256_hash", "dlq_retry"), get("raw_payload", ""), get("synthetic_intent", ""),
        F.lit("P1").alias("severity"), F.lit(1).alias("priority"))
    return rows


def retry_pass(letters: DataFrame, now: Column, max_retries: int = dims.DEAD_LETTER_MAX_RETRIES,
               min_age_s: int = dims.DEAD_LETTER_MIN_AGE_S) -> tuple[DataFrame, DataFrame]:
    """(rows to queue at P1, the letter table after the pass).

    Only letters whose payload could be rebuilt count as retried. That is a matter of each row by
    itself, so letters that share an id stay as many as they are.
    """
    again = resubmissions(eligible(letters, now, max_retries, min_age_s))
    retried = _eligible(now, max_retries, min_age_s) & _rebuildable()
    after = letters.withColumn(
        "retry_count", F.col("retry_count") + F.when(retried, 1).otherwise(0))
    return again, after


def escalations(letters: DataFrame, max_retries: int = dims.DEAD_LETTER_MAX_RETRIES) -> DataFrame:
    """Unresolved letters without retries left, with the uuid of the original row."""
    return letters.filter((F.col("retry_count") >= max_retries) & ~F.col("resolved")).select(
        "dlq_uuid", "work_type",
        F.coalesce(F.get_json_object("payload", "$.log_uuid"), F.lit("unknown")).alias("log_uuid"),
        "failure_reason")


def summary(letters: DataFrame) -> DataFrame:
    return letters.groupBy("work_type", "failure_reason").agg(
        F.count("*").alias("n_letters"),
        F.count_if(~F.col("resolved")).alias("n_open"),
        F.max("retry_count").alias("max_retries"))
