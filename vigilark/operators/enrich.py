"""Sentence and technique hint per row, chosen by event type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions import detect
from vigilark.functions.fields import sql_text

# ---- fixed values: sentences -------------------------------------------------------------
# {name} reads a column, null as "unknown".
SENTENCES = {
    "PROCESS_CREATION":
        "User {user_account} executed {process_name} (spawned by {parent_process_name}) "
        "on {hostname}.",
    "NETWORK_CONNECTION":
        "{process_name} on {hostname} initiated a network connection from "
        "{source_ip}:{source_port} to {dest_ip}:{dest_port}.",
    "AUTHENTICATION_FAILURE":
        "Authentication failure for user {user_account} on {hostname} from source {source_ip}.",
    "AUTHENTICATION_FAILURE_BURST":
        "Authentication failure for user {user_account} on {hostname} from source {source_ip}.",
    "DNS_QUERY": "{hostname} ({source_ip}) queried DNS for {dns_query}.",
    "HTTP_REQUEST": "{source_ip} made a {http_method} request to {http_url} on {hostname}.",
    "FILE_WRITE": "{process_name} wrote to file {file_path} on {hostname}.",
    "PRIVILEGE_ESCALATION":
        "Privilege escalation detected: {process_name} performed a privileged operation on "
        "{hostname} as user {user_account}.",
    "AUTHENTICATION_SUCCESS":
        "Successful authentication for user {user_account} on {hostname} from {source_ip}.",
    "REGISTRY_WRITE":
        "{process_name} on {hostname} modified registry key {registry_key} to value "
        "{command_line_args} — possible persistence or defense evasion.",
    "EXFILTRATION_HINT":
        "Security event log cleared on {hostname} by {user_account} — evidence destruction in "
        "progress. This is a critical indicator of compromise.",
    "LATERAL_MOVEMENT_HINT":
        "User {user_account} on {hostname} authenticated to {dest_ip} using explicit "
        "credentials — possible lateral movement with stolen credentials.",
}
FALLBACK = ("Security event of type {event_type} detected on {hostname} at {event_timestamp}. "
            "Raw event code: {event_code}.")
CREDENTIAL_DUMP = ("{process_name} on {hostname} accessed process lsass.exe — possible "
                   "credential dumping.")
OPT_IN_SENTENCES = {
    "SERVICE_INSTALL":
        "New service '{command_line_args}' installed on {hostname} with path {file_path} "
        "running as {user_account} — possible persistence mechanism.",
    "SCHEDULED_TASK":
        "Scheduled task '{command_line_args}' created on {hostname} by {user_account} — task "
        "will execute at logon/startup for persistence.",
}
OPT_IN_HINTS = {"SERVICE_INSTALL": "T1543.003", "SCHEDULED_TASK": "T1053.005"}


def fill(sentence: str, time_column: str = "event_timestamp_raw") -> str:
    """SQL text of a sentence with its {placeholders} read null-safely from columns."""
    parts = []
    for piece in sentence.split("{"):
        name, closed, rest = piece.partition("}")
        if closed:
            column = time_column if name == "event_timestamp" else name
            parts.append(f"coalesce(cast({column} AS string), 'unknown')")
            parts.append(sql_text(rest))
        else:
            parts.append(sql_text(piece))
    return f"concat({', '.join(parts)})"


ARGS = "lower(coalesce(command_line_args, ''))"
KEY = "coalesce(registry_key, 'unknown')"
LSASS = "coalesce(contains(lower(process_name), 'lsass'), false)"


def _rules(entropy_threshold: float, web_servers: list[str]) -> dict[str, list]:
    """(condition, added sentence, hint) per event type; the last match gives the hint.

    The added sentence uses the same placeholders as the main ones.
    """
    return {
        "PROCESS_CREATION": [
            ("length(command_line_args) > 0",
             " Command line arguments indicate {command_line_args}.", None),
            (f"contains({ARGS}, 'vssadmin') AND contains({ARGS}, 'delete')",
             " Shadow copies deleted — ransomware preparation or anti-forensics.", "T1490"),
            (f"contains({ARGS}, 'wevtutil') AND contains({ARGS}, 'cl')",
             " Event log cleared via wevtutil.", "T1070.001"),
            (f"contains({ARGS}, 'bcdedit') AND contains({ARGS}, 'recoveryenabled no')",
             " Boot recovery disabled.", "T1490"),
            (detect.web_server_sql("coalesce(parent_process_name, 'unknown')", web_servers),
             " Parent process is a web server — possible web shell execution.", "T1505.003"),
        ],
        "NETWORK_CONNECTION": [
            ("dest_port = 443", " Connection is HTTPS-encrypted.", None),
            (detect.private_ip_sql("dest_ip"),
             " Destination is an internal host — possible lateral movement.", "T1021"),
        ],
        "DNS_QUERY": [
            (detect.tunnelled_sql("dns_query", entropy_threshold),
             " Domain has high entropy — possible DNS tunneling or DGA activity.", "T1071.004"),
        ],
        "HTTP_REQUEST": [
            (detect.sql_token_sql("http_url"),
             " URL contains SQL syntax — possible injection attempt.", None),
        ],
        "FILE_WRITE": [
            (detect.system_dir_sql("file_path"),
             " Target is a protected system directory — possible persistence mechanism.",
             "T1543"),
        ],
        "PRIVILEGE_ESCALATION": [("true", "", "T1055"), (LSASS, "", "T1003.001")],
        "REGISTRY_WRITE": [
            (f"contains({KEY}, 'Run')", " Registry run key persistence detected.", "T1547.001"),
            (f"contains({KEY}, 'DisableAntiSpyware') OR contains({KEY}, 'DisableRealtimeMonitoring')",
             " Antivirus disabled via registry.", "T1562.001"),
        ],
        "EXFILTRATION_HINT": [("true", "", "T1070.001")],
        "LATERAL_MOVEMENT_HINT": [("true", "", "T1021")],
    }


def enrich(rows: DataFrame, entropy_threshold: float = dims.DNS_ENTROPY_THRESHOLD,
           web_servers: list[str] | None = None, opt_in: bool = False,
           time_column: str = "event_timestamp_raw") -> DataFrame:
    """Set ``synthetic_intent`` and, where a rule gives one, ``mitre_technique_hint``.

    ``opt_in`` adds the declared sentences for service installs and scheduled tasks.
    """
    sentences = {**SENTENCES, **(OPT_IN_SENTENCES if opt_in else {})}
    rules = _rules(entropy_threshold, web_servers or dims.INTENT_WEB_SERVERS)
    if opt_in:
        rules.update({t: [("true", "", hint)] for t, hint in OPT_IN_HINTS.items()})

    texts, hints = [], []
    for name, sentence in sentences.items():
        base = fill(sentence, time_column)
        if name == "PRIVILEGE_ESCALATION":
            base = f"CASE WHEN {LSASS} THEN {fill(CREDENTIAL_DUMP)} ELSE {base} END"
        added = [f"CASE WHEN {cond} THEN {fill(extra)} ELSE '' END"
                 for cond, extra, _ in rules.get(name, []) if extra]
        texts.append(f"WHEN '{name}' THEN concat({', '.join([base, *added])})")
        found = [f"WHEN {cond} THEN '{technique}'"
                 for cond, _, technique in reversed(rules.get(name, [])) if technique]
        if found:
            hints.append(f"WHEN '{name}' THEN CASE {' '.join(found)} END")
    return rows.withColumns({
        "synthetic_intent": F.expr(
            f"CASE event_type {' '.join(texts)} ELSE {fill(FALLBACK, time_column)} END"),
        "mitre_technique_hint": F.expr(
            f"coalesce(CASE event_type {' '.join(hints)} END, mitre_technique_hint)"),
    })


def technique_counts(enriched: DataFrame) -> DataFrame:
    """Rows per technique and host."""
    return (
        enriched.filter(F.col("mitre_technique_hint").isNotNull())
        .groupBy("mitre_technique_hint", "hostname").agg(F.count("*").alias("n_events"))
    )
