"""Queue severity, the two triage scores, list joins and the gates that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.dims import ThreatConfig
from vigilark.functions.detect import base_name, contains_any
from vigilark.functions.fields import map_lit


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _process(column: str, basename: bool) -> Column:
    """Lower-case process name, as logged or without its folders; missing reads as empty."""
    name = base_name(column) if basename else F.col(column)
    return F.lower(F.coalesce(name, F.lit("")))


def queue_severity(rows: DataFrame, basename: bool = False) -> DataFrame:
    """Add ``severity`` and ``priority``; the row's own hint is looked at last.

    The shell rule compares names as logged; ``basename`` lets it match full paths.
    """
    kind, intent = F.col("event_type"), F.col("synthetic_intent")
    shell = (_process("parent_process_name", basename).isin(*dims.WEB_SERVERS)
             & _process("process_name", basename).isin(*dims.SHELLS))
    severity = (
        F.when(kind.isin(*dims.QUEUE_P0_TYPES), "P0")
        .when(kind.isin(*dims.QUEUE_P1_TYPES), "P1")
        .when((kind == "PROCESS_CREATION") & shell, "P1")
        .when((kind == "NETWORK_CONNECTION") & F.col("dest_port").isin(*dims.UNUSUAL_PORTS), "P1")
        .when(F.length("mitre_technique_hint") > 0, "P2")
        .when(kind == "AUTHENTICATION_FAILURE", "P2")
        .when((kind == "DNS_QUERY") & intent.contains("high entropy"), "P2")
        .when((kind == "HTTP_REQUEST") & intent.contains("SQL syntax"), "P2")
        .when((kind == "FILE_WRITE") & intent.contains("system directory"), "P2")
        .otherwise(F.coalesce("severity_hint", F.lit("BENIGN")))
    )
    priority = map_lit(dims.QUEUE_PRIORITY)
    return rows.withColumn("severity", severity).withColumn("priority", priority[F.col("severity")])


LIST_COLUMNS = ("listed_process", "listed_hash", "listed_ip")


def _conditions(config: ThreatConfig, scan_threshold: int,
                basename: bool, listed: bool = False) -> list[tuple[str, Column, Column]]:
    """(weight name, condition, flag) for the thirteen conditions, in flag order.

    With ``listed``, the hits of the long lists are columns of the rows.
    """
    process = _process("process_name", basename)
    parent = _process("parent_process_name", basename)
    args = F.lower(F.coalesce("command_line_args", F.lit("")))
    kind = F.col("event_type")
    if listed:
        name_hit, hash_hit, ip_hit = (F.col(c) for c in LIST_COLUMNS)
    else:
        # A short list is a literal, folded into the scan; threat_lists.with_list_hits is for long ones.
        ips = list(config.known_c2_ips)
        name_hit = contains_any(process, [p.lower() for p in config.dangerous_processes])
        hash_hit = contains_any(F.upper("raw_payload"), [h.upper() for h in config.known_bad_hashes])
        ip_hit = _true(F.col("source_ip").isin(*ips)) | _true(F.col("dest_ip").isin(*ips))
    critical = F.concat(F.lit("critical_event:"), kind)
    return [
        ("dangerous_process", name_hit,
         F.concat(F.lit("dangerous_process:"), process)),
        ("webserver_parent_cmd_child",
         parent.isin(*dims.WEB_SERVERS) & process.isin(*dims.SHELLS),
         F.concat(F.lit("webshell:"), parent, F.lit("->"), process)),
        ("c2_port", (F.col("dest_port") != 0) & F.col("dest_port").isin(*config.c2_ports),
         F.concat(F.lit("c2_port:"), F.col("dest_port").cast("string"))),
        ("privilege_escalation_event", kind == "PRIVILEGE_ESCALATION", critical),
        ("exfiltration_hint_event", kind == "EXFILTRATION_HINT", critical),
        ("ip_historical_correlation", F.col("ip_seen"), F.lit("ip_historical_correlation")),
        ("lsass_access", (kind == "PRIVILEGE_ESCALATION") & args.contains("lsass"),
         F.lit("lsass_access")),
        ("encoded_powershell", process.contains("powershell") & args.contains("-enc"),
         F.lit("encoded_powershell")),
        ("log_clearing", (kind == "EXFILTRATION_HINT") & (
            process.contains("wevtutil") | _true(F.col("event_code").isin("1102", "104"))),
         F.lit("log_clearing")),
        ("shadow_delete", args.contains("vssadmin") & args.contains("delete"),
         F.lit("shadow_delete")),
        ("known_bad_hash", hash_hit, F.lit("known_bad_hash")),
        ("large_data_transfer", F.col("bytes_sent") > dims.LARGE_TRANSFER_BYTES,
         F.lit("large_data_transfer")),
        ("port_scan_detected", (F.length("source_ip") > 0)
         & (F.col("scan_count") >= scan_threshold), F.lit("port_scan_detected")),
        ("known_c2_ip", ip_hit, F.lit("known_c2_ip")),
    ]


BASIC_CONDITIONS = ["dangerous_process", "webserver_parent_cmd_child", "c2_port",
                    "privilege_escalation_event", "exfiltration_hint_event",
                    "ip_historical_correlation"]


def triage_score(rows: DataFrame, config: ThreatConfig | None = None, profile: str = "full",
                 scan_threshold: int = dims.PORT_SCAN_THRESHOLD,
                 basename: bool = False) -> DataFrame:
    """Add ``score``, ``heuristic_flags``, ``triage_severity`` and what follows from them.

    Expects ``ip_seen`` (boolean) and ``scan_count`` (int) from the activity
    operators; missing columns read as "not seen" and zero. ``profile="basic"``
    scores the first five conditions with the built-in weights and thresholds;
    ``basename`` strips folders from process names first. Rows with ``listed_process``, ``listed_hash``
    and ``listed_ip`` (``threat_lists.with_list_hits``) use these instead of the lists of ``config``.
    """
    config = config or ThreatConfig()
    weights, limits = config.scoring_weights, config.severity_thresholds
    if "ip_seen" not in rows.columns:
        rows = rows.withColumn("ip_seen", F.lit(False))
    if "scan_count" not in rows.columns:
        rows = rows.withColumn("scan_count", F.lit(0))
    conditions = _conditions(config, scan_threshold, basename, set(LIST_COLUMNS) <= set(rows.columns))
    if profile == "basic":
        weights, limits = dims.WEIGHTS, dims.THRESHOLDS
        conditions = [c for c in conditions if c[0] in BASIC_CONDITIONS]

    score = F.lit(0)
    for name, condition, _ in conditions:
        score = score + F.when(condition, weights[name]).otherwise(0)
    flags = F.array_compact(F.array(*[F.when(cond, flag) for _, cond, flag in conditions]))
    total = F.col("score")
    severity = F.lit("BENIGN")
    for name in ("P2", "P1", "P0"):
        severity = F.when(total >= limits[name], name).otherwise(severity)
    return (
        rows.withColumns({"score": score, "heuristic_flags": flags})
        .withColumn("triage_severity", severity)
        .withColumns({
            "correlation_required": F.col("triage_severity").isin("P0", "P1"),
            "anomaly_detected": total > limits["P2"] - 1,
            "confidence": F.least(total / 100, F.lit(1.0)),
        })
    )


def with_route(triaged: DataFrame) -> DataFrame:
    """Add ``route``: stop, report_only (no correlation) or correlate."""
    severity = F.col("triage_severity")
    return triaged.withColumn("route", F.when(severity == "BENIGN", "stop").when(severity == "P2", "report_only")
                              .otherwise("correlate"))


def triage_routes(triaged: DataFrame) -> dict[str, DataFrame]:
    """One frame per route. Each is a plan of its own: write the frame of ``with_route`` where all are needed."""
    routed = with_route(triaged)
    return {name: routed.filter(F.col("route") == name).drop("route") for name in ("stop", "report_only", "correlate")}


def bad_hash_matches(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows whose payload holds a listed 64-digit hash: token join, so the list may be long.

    A hash may stand inside a longer run of digits, so every place of a run is a token.
    """
    tokens = rows.select(
        "log_uuid", F.explode(F.array_distinct(F.regexp_extract_all(
            F.upper("raw_payload"), F.lit("(?=([0-9A-F]{64}))"), F.lit(1)))).alias("hash"))
    return tokens.join(hashes.select(F.upper("hash").alias("hash")).distinct(), "hash", "inner")


def c2_matches(rows: DataFrame, c2_ips: DataFrame) -> DataFrame:
    """Rows with a listed address at either end; small lists are broadcast by Spark itself."""
    listed = c2_ips.select("ip").distinct()
    source = listed.select(F.col("ip").alias("source_ip"), F.lit(True).alias("source_hit"))
    dest = listed.select(F.col("ip").alias("dest_ip"), F.lit(True).alias("dest_hit"))
    return (
        rows.join(source, "source_ip", "left").join(dest, "dest_ip", "left")
        .filter(F.col("source_hit") | F.col("dest_hit"))
        .withColumns({"source_hit": F.coalesce("source_hit", F.lit(False)),
                      "dest_hit": F.coalesce("dest_hit", F.lit(False))})
    )


def threat_join(rows: DataFrame, listed: DataFrame, column: str, keep_matches: bool = True) -> DataFrame:
    """Rows whose ``column`` is on the one-column list, or the clean remainder."""
    right = listed.select(F.col(listed.columns[0]).alias(column)).distinct()
    return rows.join(right, column, "left_semi" if keep_matches else "left_anti")


def firewall_rules(rows: DataFrame) -> DataFrame:
    """Opt-in rules for allowed connections: listed C2 end point, and large transfers."""
    allowed = F.upper("action") == "ALLOW"
    c2 = allowed & F.col("dest_ip").isin(*dims.C2_IPS) & F.col("dest_port").isin(*dims.C2_RULE_PORTS)
    large = allowed & (F.col("bytes_sent") > dims.LARGE_TRANSFER_BYTES)
    return rows.withColumns({
        "mitre_technique_hint": F.when(c2, "T1071").otherwise(F.col("mitre_technique_hint")),
        "event_type": F.when(large, "EXFILTRATION_HINT").otherwise(F.col("event_type")),
        "rule": F.when(c2 & large, "c2+large").when(c2, "c2").when(large, "large"),
    }).filter(F.col("rule").isNotNull())


def with_handoff_failure(stage_rows: DataFrame, expected_stage: str,
                         version: str = dims.SCHEMA_VERSION) -> DataFrame:
    """Add ``failure_reason``, null for rows that may pass."""
    bad_version = ~F.col("schema_version").eqNullSafe(version)
    bad_stage = ~F.col("from_skill").eqNullSafe(expected_stage)
    return stage_rows.withColumn(
        "failure_reason", F.when(bad_version, "schema_version_mismatch")
        .when(bad_stage, "invalid_manifest"))


def handoff_gate(stage_rows: DataFrame, expected_stage: str,
                 version: str = dims.SCHEMA_VERSION) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, dead letters) by schema version and sending stage."""
    checked = with_handoff_failure(stage_rows, expected_stage, version)
    accepted = checked.filter(F.col("failure_reason").isNull()).drop("failure_reason")
    letters = checked.filter(F.col("failure_reason").isNotNull()).select(
        F.sha2(F.concat(F.lit("HANDOFF"), F.col("log_uuid")), 256).alias("dlq_uuid"),
        F.lit("HANDOFF").alias("work_type"),
        F.to_json(F.struct("log_uuid", "from_skill", "schema_version")).alias("payload"),
        "failure_reason")
    return accepted, letters


def severity_summary(rows: DataFrame, severity: str = "triage_severity") -> DataFrame:
    """Counts by event type and severity with subtotals; nulls mark the totals."""
    return rows.rollup("event_type", severity).agg(F.count("*").alias("n_events"))


def outcome_counts(severity: str = "triage_severity", failed: str = "normalize_failed") -> dict[str, Column]:
    """What became of the rows, as aggregates of one pass: totals, dead letters, and rows by severity."""
    counts = {"ingested": F.count("*"), "dead_letters": F.count_if(F.col(failed)),
              "embedded": F.count_if((F.col(severity) != "BENIGN") & (F.length(F.trim("synthetic_intent")) > 0)),
              "correlated": F.count_if(F.col("correlation_required"))}
    return counts | {name.lower(): F.count_if(F.col(severity) == name) for name in dims.SEVERITIES} | {
        "techniques": F.approx_count_distinct(F.when(F.length("mitre_technique_hint") > 0, F.col("mitre_technique_hint")), 0.01)}


def outcome_totals(triaged: DataFrame) -> DataFrame:
    """(metric, value) of :func:`outcome_counts`; techniques, a short list, are counted exactly."""
    counts = outcome_counts() | {"techniques": F.size(F.collect_set(F.when(F.length("mitre_technique_hint") > 0, F.col("mitre_technique_hint"))))}
    row = triaged.agg(*(c.cast("bigint").alias(name) for name, c in counts.items()))
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in counts))))


def p0_alerts(triaged: DataFrame) -> DataFrame:
    """One alert text per P0 row."""
    def shown(name: str, missing: str) -> Column:
        return F.when(F.length(name) > 0, F.col(name)).otherwise(missing)

    # Fixed wording of the alert.
    message = F.concat(
        F.lit("🔴 *P0 CRITICAL — Pre-Correlation Alert*\n\nEvent: `"), F.col("event_type"),
        F.lit("`\nHost: `"), shown("hostname", "unknown"), F.lit("`\nSource: `"),
        shown("source_ip", "N/A"), F.lit("` → `"), shown("dest_ip", "N/A"),
        F.lit("`\nLog UUID: `"), F.col("log_uuid"), F.lit("`\n\n_Full analysis in progress..._"))
    return triaged.filter(F.col("triage_severity") == "P0").select(
        "log_uuid", message.alias("message"))
