"""Map identified lines to the canonical row in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.fields import (iso_from_epoch, map_lit, safe_str, sql_text,
                                       to_time)

ZEEK = ["zeek_conn", "zeek_dns", "zeek_http", "zeek_ssl"]


def _zeek(*keys: str) -> dict[str, list[str]]:
    return {source: list(keys) for source in ZEEK}


# ---- fixed values: candidate keys per column and source ----------------------------------
TIME_KEYS = {
    "sysmon": ["UtcTime", "TimeCreated", "ts", "timestamp"],
    "windows_event": ["TimeCreated", "timestamp", "@timestamp"],
    **_zeek("ts"),
    "firewall": ["timestamp", "ts", "date", "time"],
    "unknown": ["timestamp", "ts", "@timestamp", "time", "date", "event_timestamp"],
}
TEXT_KEYS = {
    "hostname": {
        "sysmon": ["hostname", "Computer", "host.name", "ComputerName"],
        "windows_event": ["hostname", "Computer", "Workstation"],
        **_zeek("hostname", "host"),
        "firewall": ["hostname", "device"],
        "unknown": ["hostname", "host", "Computer"],
    },
    "source_ip": {
        "sysmon": ["SourceIp", "src_ip", "SourceAddress"],
        "windows_event": ["IpAddress", "SourceNetworkAddress"],
        **_zeek("id.orig_h"),
        "firewall": ["src_ip", "src", "SRC", "source_ip"],
        "unknown": ["source_ip", "src_ip", "src"],
    },
    "dest_ip": {
        "sysmon": ["DestinationIp", "dst_ip", "DestinationAddress"],
        "windows_event": ["DestAddress", "TargetServerName"],
        **_zeek("id.resp_h"),
        "firewall": ["dst_ip", "dst", "DST", "dest_ip"],
        "unknown": ["dest_ip", "dst_ip", "dst"],
    },
    "process_name": {
        "sysmon": ["Image", "process.name", "process_name", "source"],
        "windows_event": ["NewProcessName", "ProcessName"],
        **_zeek("source"),
        "firewall": ["source"],
        "unknown": ["process_name", "process.name", "Image"],
    },
    "parent_process_name": {
        "sysmon": ["ParentImage", "process.parent.name", "ParentProcessName"],
        "windows_event": ["ParentProcessName"],
        "unknown": ["parent_process_name", "ParentImage"],
    },
    "user_account": {
        "sysmon": ["User", "user.name", "SubjectUserName"],
        "windows_event": ["TargetUserName", "SubjectUserName"],
        "unknown": ["user_account", "User", "user.name"],
    },
    "command_line_args": {
        "sysmon": ["CommandLine", "process.command_line"],
        "windows_event": ["CommandLine"],
        "unknown": ["command_line_args", "CommandLine"],
    },
    "event_code": {"sysmon": ["EventID", "event.code"], "windows_event": ["EventID"]},
    "file_path": {
        "sysmon": ["TargetFilename", "file.path"],
        "unknown": ["file_path", "TargetFilename"],
    },
    "registry_key": {"sysmon": ["TargetObject"]},
    "dns_query": {"sysmon": ["QueryName"], "zeek_dns": ["query"], "zeek_ssl": ["server_name"]},
    "http_method": {"zeek_http": ["method"]},
    "given_intent": {"unknown": ["synthetic_intent"]},
    "severity_hint": {"unknown": ["severity", "priority", "severity_hint"]},
}
NUMBER_KEYS = {
    "source_port": {
        "windows_event": ["IpPort", "SourcePort"],
        **_zeek("id.orig_p"),
        "firewall": ["src_port", "spt", "SPT", "source_port"],
        "unknown": ["source_port", "src_port"],
    },
    "dest_port": {
        "sysmon": ["DestinationPort", "dst_port"],
        "windows_event": ["DestPort"],
        **_zeek("id.resp_p"),
        "firewall": ["dst_port", "dpt", "DPT", "dest_port"],
        "unknown": ["dest_port", "dst_port"],
    },
    "bytes_sent": {"zeek_conn": ["orig_bytes"], "zeek_http": ["request_body_len"]},
    "bytes_received": {"zeek_conn": ["resp_bytes"], "zeek_http": ["response_body_len"]},
}
NUMBER_TYPES = {"bytes_sent": "bigint", "bytes_received": "bigint"}
# What process_name reads as when none of its keys is present.
PROCESS_DEFAULTS = {"sysmon": "sysmon", "firewall": "firewall", **{z: z for z in ZEEK}}
FIXED_TYPES = {"zeek_conn": "NETWORK_CONNECTION", "zeek_dns": "DNS_QUERY",
               "zeek_http": "HTTP_REQUEST", "zeek_ssl": "DNS_QUERY",
               "firewall": "NETWORK_CONNECTION"}
LOG_CLEARED_CODES = ["1102", "104"]


def _by_branch(table: dict[str, list[str]], chain) -> str:
    """SQL text that handles each branch's candidate keys with ``chain``; null for other branches."""
    branches: dict[str, list[str]] = {}
    for source, keys in table.items():
        branches.setdefault(chain(keys), []).append(source)
    cases = [f"WHEN _branch IN ({', '.join(sql_text(s) for s in sources)}) THEN {text}"
             for text, sources in branches.items()]
    return f"CASE {' '.join(cases)} END"


def _first_present(keys: list[str]) -> str:
    """Value of the first key the map holds, even when that value is null."""
    return "CASE " + " ".join(
        f"WHEN map_contains_key(fields, {sql_text(k)}) THEN fields[{sql_text(k)}]" for k in keys
    ) + " END"


def _any_present(keys: list[str]) -> str:
    return "(" + " OR ".join(f"map_contains_key(fields, {sql_text(k)})" for k in keys) + ")"


def _first_non_null(keys: list[str]) -> str:
    """Name of the first key with a value."""
    return "CASE " + " ".join(
        f"WHEN fields[{sql_text(k)}] IS NOT NULL THEN {sql_text(k)}" for k in keys) + " END"


def _value(table: dict[str, list[str]]) -> str:
    return _by_branch(table, _first_present)


def event_types(parsed: DataFrame, extra_windows: bool = False) -> DataFrame:
    """Add ``mapped_type``: the code map joined on (source, code), ``UNKNOWN`` on a miss."""
    codes = F.broadcast(dims.event_code_dim(parsed.sparkSession, extra_windows))
    return (
        parsed.join(codes.withColumnsRenamed({"source": "log_source", "code": "event_code"}),
                    ["log_source", "event_code"], "left")
        .withColumn("mapped_type", F.coalesce("mapped_type", F.lit("UNKNOWN")))
    )


def normalize(identified: DataFrame, line: str = "line", extra_windows: bool = False,
              ingested_at: Column | None = None, discard_source_image: bool = False,
              keep: tuple[str, ...] = ("log_uuid", "source_path")) -> DataFrame:
    """Canonical columns for every non-empty line, plus ``normalize_failed``.

    ``ingested_at`` is the ingestion time (also the event time of a line that
    names none). ``discard_source_image`` keeps the full ``Image`` for Sysmon
    code 10 instead of the base name of ``SourceImage``.
    """
    now = F.current_timestamp() if ingested_at is None else ingested_at
    fields = F.col("fields")
    kept = identified.filter(F.col("format") != "empty")
    branch = F.when(F.col("log_source").isin("syslog", "unknown"), "unknown").otherwise(
        F.col("log_source"))
    kept = kept.withColumn("_branch", branch)

    picked = {name: F.expr(f"nullif({_value(table)}, '')") for name, table in TEXT_KEYS.items()}
    picked["hostname"] = F.expr(_value(TEXT_KEYS["hostname"]))
    picked.update({
        name: F.expr(f"try_cast(trim({_value(table)}) AS {NUMBER_TYPES.get(name, 'int')})")
        for name, table in NUMBER_KEYS.items()
    })
    time_key = F.expr(_by_branch(TIME_KEYS, _first_non_null))
    kept = kept.withColumns({**picked, "_time_key": time_key})
    kept = event_types(kept, extra_windows)

    sysmon, windows = F.col("_branch") == "sysmon", F.col("_branch") == "windows_event"
    http, unknown = F.col("_branch") == "zeek_http", F.col("_branch") == "unknown"
    opened = F.coalesce(sysmon & (F.col("event_code") == "10"), F.lit(False))
    set_value = F.coalesce(sysmon & (F.col("event_code") == "13"), F.lit(False))
    cleared = F.coalesce(windows & F.col("event_code").isin(*LOG_CLEARED_CODES), F.lit(False))

    def field_or(key: str, default: str) -> Column:
        return F.when(F.map_contains_key(fields, key), safe_str(fields[key])).otherwise(default)

    def text(value: Column) -> Column:
        return F.coalesce(value, F.lit("None"))

    given = F.upper(F.when(F.map_contains_key(fields, "event_type"), fields["event_type"])
                    .otherwise("UNKNOWN"))
    failed = unknown & (given.isNull() | F.array_contains("numeric_keys", "event_type"))
    kind = (
        F.when(unknown, F.when(given.isin(*dims.EVENT_TYPES), given).otherwise("UNKNOWN"))
        .otherwise(F.coalesce(map_lit(FIXED_TYPES)[F.col("_branch")], F.col("mapped_type")))
    )
    source_image = field_or("SourceImage", "")
    opener = F.when(F.length(source_image) > 0,
                    F.element_at(F.split(source_image, r"\\"), -1)).otherwise("unknown")
    has_process_key = F.expr(_by_branch(TEXT_KEYS["process_name"], _any_present))
    process = F.when(~has_process_key, map_lit(PROCESS_DEFAULTS)[F.col("_branch")]
                     ).otherwise(F.col("process_name"))
    process = (
        F.when(cleared, "wevtutil.exe")
        .when(windows, F.coalesce(process, field_or("source", "windows_event")))
        .otherwise(process)
    )
    if not discard_source_image:
        process = F.when(opened, opener).otherwise(process)
    args = (
        F.when(opened, F.concat(F.lit("GrantedAccess:"), text(field_or("GrantedAccess", "?")),
                                F.lit(" Target:"), text(field_or("TargetImage", "?"))))
        .when(set_value, field_or("Details", "?"))
        .when(cleared, F.concat(F.lit("EventLogCleared:Channel="),
                                F.when(F.map_contains_key(fields, "Channel"),
                                       text(fields["Channel"])).otherwise("Security")))
        .otherwise(F.col("command_line_args"))
    )
    host_header, uri = safe_str(fields["host"]), field_or("uri", "")
    uri = safe_str(uri)
    url = F.when(http, F.when(host_header.isNotNull() & uri.isNotNull(),
                              F.concat(F.lit("http://"), host_header, uri)).otherwise(uri))
    no_host = F.when(unknown, "unknown").otherwise("unknown_host")
    raw_time = fields[F.col("_time_key")]
    time_text = F.when(F.array_contains("numeric_keys", F.col("_time_key")),
                       iso_from_epoch(raw_time.try_cast("double"))).otherwise(raw_time)

    columns = {
        "ingestion_timestamp": now,
        "event_timestamp_raw": time_text,
        "event_timestamp": F.when(time_text.isNull(), now).otherwise(to_time(time_text)),
        "event_type": kind,
        "hostname": F.coalesce(F.col("hostname"), no_host),
        "sha256_hash": F.sha2(F.col(line), 256),
        "raw_payload": F.col(line),
        "synthetic_intent": F.coalesce(F.col("given_intent"), F.lit("")),
        "source_ip": F.col("source_ip"),
        "dest_ip": F.when(opened, field_or("TargetImage", "unknown")).otherwise(F.col("dest_ip")),
        "source_port": F.col("source_port"),
        "dest_port": F.col("dest_port"),
        "process_name": process,
        "parent_process_name": F.col("parent_process_name"),
        "user_account": F.col("user_account"),
        "event_code": F.when(sysmon | windows, F.coalesce("event_code", F.lit(""))),
        "file_path": F.col("file_path"),
        "registry_key": F.col("registry_key"),
        "command_line_args": args,
        "dns_query": F.col("dns_query"),
        "http_url": url,
        "http_method": F.col("http_method"),
        "bytes_sent": F.col("bytes_sent"),
        "bytes_received": F.col("bytes_received"),
        "mitre_technique_hint": F.lit(None).cast("string"),
        "severity_hint": F.when(F.col("severity_hint").isin(*dims.SEVERITIES),
                                F.col("severity_hint")),
    }
    # A failed line keeps only the custody columns; everything else falls back.
    fallback = {"event_type": F.lit("UNKNOWN"), "hostname": F.lit("unknown"),
                "synthetic_intent": F.lit(""), "event_timestamp": now,
                "ingestion_timestamp": now, "sha256_hash": columns["sha256_hash"],
                "raw_payload": columns["raw_payload"]}
    out = [
        (value if name in ("ingestion_timestamp", "sha256_hash", "raw_payload")
         else F.when(failed, fallback.get(name, F.lit(None))).otherwise(value)).alias(name)
        for name, value in columns.items()
    ]
    extra = [name for name in keep if name in identified.columns]
    rows = kept.select(*extra, "log_source", "format", *out, failed.alias("normalize_failed"))
    # A plain projection: a job computes only the columns it reads.
    return rows


def assign_uuids(lines: DataFrame, path: str = "source_path", line: str = "line",
                 block: str = "block_start") -> DataFrame:
    """Add a repeatable ``log_uuid``: hash of path, line and the copy's number.

    Copies of a line are interchangeable, so a copy's number may be any of
    0..n-1 as long as each is used once. Copies are numbered inside the file
    block they were read from; the copies in earlier blocks are added from a
    pre-aggregated count, so no task holds all copies of a popular line.
    """
    from pyspark.sql import Window

    keyed = lines.withColumn("_line_hash", F.xxhash64(path, line)).withColumn(
        "_order", F.monotonically_increasing_id())
    keys = ["_line_hash", path, line]
    in_block = keyed.groupBy(*keys, block).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    # Lines seen in a single block need no offset, which is nearly all of them.
    offsets = (
        in_block.withColumn("_before", F.sum("_n").over(earlier))
        .filter(F.col("_before").isNotNull()).select(*keys, block, "_before")
    )
    local = Window.partitionBy(*keys, block).orderBy("_order")
    return (
        keyed.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [*keys, block], "left")
        .withColumn("log_uuid", F.sha2(F.concat_ws(
            "\u0000", F.col(path), F.col(line),
            (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("string")), 256))
        .drop("_line_hash", "_order", "_local", "_before")
    )


def split_ingest(normalized: DataFrame, row_id: str = "log_uuid") -> tuple[DataFrame, DataFrame]:
    """(rows to store, dead letters) of a normalised frame.

    A line whose normaliser failed is stored as its minimal row, which keeps its custody whole, and gets
    a letter with the whole line as well. ``row_id`` tells equal lines apart, so every letter has an id of its own.
    """
    bad = normalized.filter("normalize_failed")
    payload = F.to_json(F.struct(F.col("source_path").alias("file_path"), F.col("raw_payload").alias("raw_line")))
    letters = bad.select(
        F.sha2(F.concat_ws("|", F.lit("INGESTION"), "source_path", F.col(row_id).cast("string"), "sha256_hash"), 256)
        .alias("dlq_uuid"),
        F.lit("INGESTION").alias("work_type"), payload.alias("payload"),
        F.lit("event_type is not text").alias("failure_reason"),
        F.date_format("ingestion_timestamp", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("failed_at"),
        F.lit(0).alias("retry_count"), F.lit(False).alias("resolved"))
    return normalized, letters


def inject_rows(requests: DataFrame) -> DataFrame:
    """Caller-supplied rows: an unknown event type becomes ``UNKNOWN``, the hash is added."""
    kind = F.col("event_type")
    return (
        requests.withColumn("event_type", F.when(kind.isin(*dims.EVENT_TYPES), kind)
                            .otherwise("UNKNOWN"))
        .withColumn("hostname", F.coalesce("hostname", F.lit("TEST-HOST")))
        .withColumn("raw_payload", F.col("raw_line"))
        .withColumn("sha256_hash", F.sha2("raw_line", 256))
        .drop("raw_line")
    )
