"""Custody checks and sanitising over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilark.functions.text import has_injection, sanitize_basic

NEVER_SANITIZED = ("sha256_hash", "log_uuid")


def with_custody_hash(rows: DataFrame, payload: str = "raw_payload") -> DataFrame:
    return rows.withColumn("sha256_hash", F.sha2(payload, 256))


def tampered(archive: DataFrame) -> DataFrame:
    """Archive rows whose payload no longer matches its hash."""
    return archive.filter(F.sha2("raw_payload", 256) != F.col("sha256_hash"))


def tamper_audit(archive: DataFrame) -> DataFrame:
    """Checked and tampered rows per day."""
    bad = F.sha2("raw_payload", 256) != F.col("sha256_hash")
    return archive.groupBy(F.to_date("event_timestamp").alias("event_date")).agg(
        F.count("*").alias("n_checked"), F.count_if(bad).alias("n_tampered"))


def sanitize_columns(rows: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Every text column, whole, through the basic sanitiser; hash and uuid left alone."""
    return rows.select(*[
        sanitize_basic(f.name, max_chars).alias(f.name)
        if isinstance(f.dataType, T.StringType) and f.name not in NEVER_SANITIZED
        else F.col(f.name) for f in rows.schema.fields])


def injection_flags(texts: DataFrame, text: str, *group: str) -> DataFrame:
    """Texts and flagged texts per group."""
    return texts.groupBy(*group).agg(
        F.count("*").alias("n_texts"), F.count_if(has_injection(text)).alias("n_flagged"))
