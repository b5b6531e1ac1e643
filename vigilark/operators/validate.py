"""Checks of canonical rows against the schema rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark import dims

REQUIRED = ["log_uuid", "event_timestamp", "event_type", "hostname", "sha256_hash", "raw_payload"]


def rules() -> dict[str, Column]:
    """Rule name to the condition that breaks it."""
    broken = {f"missing_{name}": F.col(name).isNull() for name in REQUIRED}
    broken["event_type_outside_taxonomy"] = ~F.col("event_type").isin(*dims.EVENT_TYPES)
    broken["severity_outside_list"] = ~F.col("severity_hint").isin(*dims.SEVERITIES)
    broken["confidence_out_of_range"] = ~F.col("confidence").between(0.0, 1.0)
    broken["bad_hash_format"] = ~F.col("sha256_hash").rlike("^[0-9a-f]{64}$")
    for name in ("source_port", "dest_port"):
        broken[f"{name}_not_integer"] = F.col(name).isNotNull() & F.col(name).try_cast("int").isNull()
    return broken


def _applicable(rows: DataFrame) -> dict[str, Column]:
    optional = {"severity_outside_list": "severity_hint", "confidence_out_of_range": "confidence"}
    return {name: F.coalesce(cond, F.lit(False)) for name, cond in rules().items()
            if optional.get(name, "log_uuid") in rows.columns}


def violations(rows: DataFrame) -> DataFrame:
    """(rule, n_violations) in one pass."""
    checks = _applicable(rows)
    totals = rows.agg(*[F.count_if(cond).alias(name) for name, cond in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_violations"))
                      for n in checks])
    return totals.select(F.inline(pairs))


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that fail with the names of the broken rules)."""
    checks = _applicable(rows)
    marked = rows.withColumn("broken_rules", F.array_compact(
        F.array(*[F.when(cond, F.lit(name)) for name, cond in checks.items()])))
    return (marked.filter(F.size("broken_rules") == 0).drop("broken_rules"),
            marked.filter(F.size("broken_rules") > 0))
