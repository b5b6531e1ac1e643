"""A job works out only the canonical columns that it reads."""

from pyspark.sql import functions as F

from vigilark.operators import normalize, parse


def test_normalize_leaves_out_unread_columns(spark):
    lines = spark.createDataFrame([(1, "/a.json", '{"source":"sysmon","UtcTime":"2024-01-01 00:00:00","TargetObject":"HKLM"}')],
                                  "event_id long, source_path string, line string")
    rows = normalize.normalize(parse.identify_source(parse.parse_lines(lines)), ingested_at=F.lit("2024-02-01").cast("timestamp"),
                               keep=("event_id", "source_path"))
    few = rows.select("event_id", "event_timestamp_raw")
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "UtcTime" in plan and "TargetObject" not in plan and "sha2" not in plan
    assert [tuple(r) for r in few.collect()] == [(1, "2024-01-01 00:00:00")]
    assert rows.select("registry_key").first()[0] == "HKLM"
