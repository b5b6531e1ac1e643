"""The canonical log row and the other table shapes."""

from __future__ import annotations

from pyspark.sql import types as T

CANONICAL = T.StructType([
    T.StructField("log_uuid", T.StringType(), False),
    T.StructField("ingestion_timestamp", T.TimestampType()),
    T.StructField("event_timestamp", T.TimestampType()),
    T.StructField("event_timestamp_raw", T.StringType()),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("hostname", T.StringType(), False),
    T.StructField("sha256_hash", T.StringType(), False),
    T.StructField("raw_payload", T.StringType(), False),
    T.StructField("synthetic_intent", T.StringType(), False),
    T.StructField("source_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("process_name", T.StringType()),
    T.StructField("parent_process_name", T.StringType()),
    T.StructField("user_account", T.StringType()),
    T.StructField("event_code", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("registry_key", T.StringType()),
    T.StructField("command_line_args", T.StringType()),
    T.StructField("dns_query", T.StringType()),
    T.StructField("http_url", T.StringType()),
    T.StructField("http_method", T.StringType()),
    T.StructField("bytes_sent", T.LongType()),
    T.StructField("bytes_received", T.LongType()),
    T.StructField("mitre_technique_hint", T.StringType()),
    T.StructField("severity_hint", T.StringType()),
])

ENTITIES = "array<struct<type:string,value:string,role:string>>"
TIMELINE = "array<struct<timestamp:string,description:string,severity:string,log_uuid:string>>"
REPORT = (
    "narrative string, confidence double, mitre_tactics array<string>, "
    f"mitre_techniques array<string>, entities {ENTITIES}, timeline_events {TIMELINE}, "
    "root_cause string, report_id string"
)
DEAD_LETTER = (
    "dlq_uuid string, work_type string, payload string, failure_reason string, "
    "failed_at string, retry_count int, resolved boolean"
)
