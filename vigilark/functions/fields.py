"""Column helpers over the parsed field map and over times kept as text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEADING_DATE = r"^\d{4}-\d{2}-\d{2}"


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sql_text(value) -> str:
    """A Python value as SQL literal text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(sql_text(v) for v in value) + ")"
    if isinstance(value, dict):
        return "map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in value.items()) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def array_lit(values: Iterable) -> Column:
    """A literal array in one expression (a call per element would cost more than the query)."""
    return F.expr(sql_text(list(values)))


def map_lit(table: dict) -> Column:
    return F.expr(sql_text(table))


def pick(fields: str | Column, *keys: str, default: str | None = None) -> Column:
    """Value of the first key present; a present null wins over later keys and the default."""
    fields = as_column(fields)
    value = F.lit(default)
    for key in reversed(keys):
        value = F.when(F.map_contains_key(fields, key), fields[key]).otherwise(value)
    return value


def safe_str(value: Column) -> Column:
    """Empty text becomes null."""
    return F.nullif(value, F.lit(""))


def iso_from_epoch(seconds: Column) -> Column:
    """UTC ISO text; the fraction appears only when there is one."""
    stamp = F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))
    whole = F.unix_micros(stamp) % 1_000_000 == 0
    return F.concat(
        F.when(whole, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        F.lit("+00:00"),
    )


def to_time(text: Column) -> Column:
    """Timestamp of ISO text, or null; a bare time or year is not a timestamp."""
    return F.when(text.rlike(LEADING_DATE), text.try_cast("timestamp"))


def iso_epoch(text: Column) -> Column:
    """Epoch seconds of ISO text, 0.0 when it does not parse."""
    return F.coalesce(F.unix_micros(to_time(text)) / 1e6, F.lit(0.0))


def once(rows: DataFrame, *names: str) -> DataFrame:
    """The same rows with the named columns worked out once per row.

    They pass through a one-element generator: Spark neither merges later
    projections into them nor pushes filters on them below, either of which
    would repeat a long expression for every mention.
    """
    rest = [c for c in rows.columns if c not in names]
    return rows.select(*rest, F.inline(F.array(F.struct(*names))))
