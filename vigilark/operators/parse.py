"""Classify raw lines, turn them into field maps and identify their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.functions.fields import as_column, once

# ---- fixed values: patterns --------------------------------------------------------------
KEY_VALUE = r'(?U)(\w+)=(?:"([^"]*?)"|(\S+))'
SYSLOG = r"(?U)^<\d+>\d?\s*\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2}|^<\d+>1\s+"
MIN_PAIRS = 3
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
PATH_SOURCES = [
    (r"(?i)sysmon|Microsoft-Windows-Sysmon", "sysmon"),
    (r"(?i)zeek.*dns|bro.*dns", "zeek_dns"),
    (r"(?i)zeek.*http|bro.*http", "zeek_http"),
    (r"(?i)zeek.*ssl|bro.*ssl", "zeek_ssl"),
    (r"(?i)zeek|bro", "zeek_conn"),
    (r"(?i)firewall|pf\.log|iptables|ufw", "firewall"),
]
# (field, accepted values or None for "present", source), most specific first.
FIELD_SOURCES = [
    ("source", ["sysmon"], "sysmon"),
    ("source", ["windows_event"], "windows_event"),
    ("source", ["zeek_conn"], "zeek_conn"),
    ("_path", ["dns"], "zeek_dns"),
    ("source", ["zeek_dns"], "zeek_dns"),
    ("_path", ["http"], "zeek_http"),
    ("source", ["zeek_http"], "zeek_http"),
    ("_path", ["ssl", "x509"], "zeek_ssl"),
    ("source", ["zeek_ssl"], "zeek_ssl"),
    ("_path", ["conn"], "zeek_conn"),
    ("source", ["firewall"], "firewall"),
    ("_path", None, "zeek_conn"),
    ("EventID", None, "windows_event"),
    ("event.code", None, "sysmon"),
]
# Keys whose JSON type matters later: times may be numbers, an event type must be text.
TYPED_KEYS = ["UtcTime", "TimeCreated", "ts", "timestamp", "@timestamp", "date", "time",
              "event_timestamp", "event_type"]
NUMERIC_KEY = r'"(?:' + "|".join(TYPED_KEYS) + r')"\s*:\s*[-0-9]'


def strip(text: str | Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(as_column(text), F.lit(WHITE_SPACE))


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``format``, ``fields`` (map) and ``numeric_keys``.

    A line is ``json`` when it is exactly one JSON object, else ``kv`` with at
    least three pairs, else ``syslog``, else ``raw``; blank lines are ``empty``
    and carry no map.
    """
    text = F.col("_text")
    # Wrapping in brackets makes text after the object a parse error or a second element.
    boxed = F.when(text.rlike(r"^\{[\s\S]*\}$"),
                   F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    parsed = (
        lines.withColumn("_text", strip(line))
        .withColumn("_box", boxed)
        .withColumn("_json", F.when(F.variant_get("_box", "$[1]", "string").isNull(),
                                    F.variant_get("_box", "$[0]", "variant")))
        .withColumn("_map", F.col("_json").try_cast("map<string,string>"))
        .withColumn("_keys", F.when(F.col("_map").isNull() & text.contains("="),
                                    F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(1))))
    )
    kind = (
        F.when(F.col("_map").isNotNull(), "json")
        .when(F.length(text) == 0, "empty")
        .when(F.size("_keys") >= MIN_PAIRS, "kv")
        .when(text.rlike(SYSLOG), "syslog")
        .otherwise("raw")
    )
    pair_map = F.map_from_arrays(
        F.col("_keys"),
        F.zip_with(
            F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(2)),
            F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(3)),
            lambda quoted, bare: F.when(F.length(quoted) > 0, quoted).otherwise(bare),
        ),
    )
    fields = (
        F.when(F.col("format") == "json", F.col("_map"))
        .when(F.col("format") == "kv", pair_map)
        .when(F.col("format") == "syslog", F.create_map(F.lit("raw_syslog"), text))
        .when(F.col("format") == "raw", F.create_map(F.lit("raw_line"), text))
    )
    numeric = [
        F.when(F.schema_of_variant(F.variant_get("_json", f"$['{key}']", "variant"))
               .rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(key))
        for key in TYPED_KEYS
    ]
    # The JSON types are only looked up in lines where a typed key is followed by a digit.
    maybe_numeric = text.rlike(NUMERIC_KEY)
    named = (
        parsed.withColumn("format", kind)
        .withColumn("fields", fields)
        .withColumn("numeric_keys", F.when((F.col("format") == "json") & maybe_numeric,
                                           F.array_compact(F.array(*numeric)))
                    .otherwise(F.array().cast("array<string>")))
        .drop("_text", "_box", "_json", "_map", "_keys")
    )
    return once(named, "format", "fields", "numeric_keys")


def source_from_path(path: str | Column) -> Column:
    path = as_column(path)
    found = F.lit(None).cast("string")
    for pattern, source in reversed(PATH_SOURCES):
        found = F.when(path.rlike(pattern), source).otherwise(found)
    return found


def source_from_fields(fields: str | Column) -> Column:
    fields = as_column(fields)
    found = F.lit(None).cast("string")
    for key, values, source in reversed(FIELD_SOURCES):
        hit = F.map_contains_key(fields, key) if values is None else fields[key].isin(*values)
        found = F.when(hit, source).otherwise(found)
    return found


def identify_source(parsed: DataFrame, path: str = "source_path", fields: str = "fields",
                    sysmon_path_wins: bool = False) -> DataFrame:
    """Add ``log_source``: fields beat the path, and neither gives ``unknown``.

    An ``EventID`` field alone means a Windows event even in a Sysmon file;
    ``sysmon_path_wins`` turns that around.
    """
    by_field, by_path = source_from_fields(fields), source_from_path(path)
    source = F.coalesce(by_field, by_path, F.lit("unknown"))
    if sysmon_path_wins:
        source = F.when((by_path == "sysmon") & (by_field == "windows_event")
                        & ~F.coalesce(F.col(fields)["source"] == "windows_event", F.lit(False)),
                        "sysmon").otherwise(source)
    return parsed.withColumn(
        "log_source", F.when(F.col("format") == "empty", "unknown").otherwise(source))


def format_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("format").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.coalesce(F.size("fields"), F.lit(0))).alias("n_fields"))
