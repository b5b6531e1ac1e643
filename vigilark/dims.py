"""Fixed values (codes, lists, weights, windows) and the small dimension tables made of them.

Everything here is bounded by construction: the largest list has a few dozen
entries, so the dimension frames may be broadcast without a size check.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: event taxonomy --------------------------------------------------------
EVENT_TYPES = [
    "PROCESS_CREATION", "NETWORK_CONNECTION", "FILE_WRITE", "FILE_DELETE", "REGISTRY_WRITE",
    "DNS_QUERY", "HTTP_REQUEST", "AUTHENTICATION_SUCCESS", "AUTHENTICATION_FAILURE",
    "AUTHENTICATION_FAILURE_BURST", "PRIVILEGE_ESCALATION", "SERVICE_INSTALL",
    "SCHEDULED_TASK", "LATERAL_MOVEMENT_HINT", "EXFILTRATION_HINT", "UNKNOWN",
]
SEVERITIES = ["P0", "P1", "P2", "BENIGN"]
SCHEMA_VERSION = "1.0.0"

# ---- fixed values: event codes -----------------------------------------------------------
EVENT_CODES = {
    "sysmon": {
        "1": "PROCESS_CREATION", "3": "NETWORK_CONNECTION", "5": "PROCESS_CREATION",
        "7": "PROCESS_CREATION", "8": "PROCESS_CREATION", "10": "PRIVILEGE_ESCALATION",
        "11": "FILE_WRITE", "12": "REGISTRY_WRITE", "13": "REGISTRY_WRITE",
        "14": "REGISTRY_WRITE", "15": "FILE_WRITE", "22": "DNS_QUERY", "23": "FILE_DELETE",
    },
    "windows_event": {
        "4624": "AUTHENTICATION_SUCCESS", "4625": "AUTHENTICATION_FAILURE",
        "4648": "AUTHENTICATION_SUCCESS", "4672": "PRIVILEGE_ESCALATION",
        "4688": "PROCESS_CREATION", "4689": "PROCESS_CREATION", "4697": "SERVICE_INSTALL",
        "4698": "SCHEDULED_TASK", "4720": "AUTHENTICATION_SUCCESS",
        "4732": "PRIVILEGE_ESCALATION", "4768": "AUTHENTICATION_SUCCESS",
        "4769": "AUTHENTICATION_SUCCESS", "5140": "LATERAL_MOVEMENT_HINT",
        "5145": "LATERAL_MOVEMENT_HINT", "1102": "EXFILTRATION_HINT",
        "104": "EXFILTRATION_HINT",
    },
}
# Codes the scenario guide asks for beyond the map above; only used when opted in.
EXTRA_WINDOWS_CODES = {
    "4648": "LATERAL_MOVEMENT_HINT", "7045": "SERVICE_INSTALL",
    "4656": "PRIVILEGE_ESCALATION", "4657": "REGISTRY_WRITE", "4104": "PROCESS_CREATION",
}

# ---- fixed values: process, port and address lists ---------------------------------------
WEB_SERVERS = ["apache2", "apache2.exe", "nginx", "nginx.exe", "w3wp.exe", "tomcat", "httpd",
               "httpd.exe"]
INTENT_WEB_SERVERS = WEB_SERVERS + ["php-cgi.exe", "node.exe", "gunicorn", "uvicorn"]
SHELLS = ["cmd.exe", "powershell.exe", "bash", "sh"]
DANGEROUS_PROCESSES = [
    "mimikatz", "mimikatz.exe", "procdump", "procdump.exe", "psexec", "psexec.exe", "wce",
    "wce.exe", "fgdump", "fgdump.exe", "gsecdump", "gsecdump.exe", "lsass", "ntdsutil",
    "ntdsutil.exe", "lazagne", "lazagne.exe", "rubeus", "rubeus.exe", "sharphound",
    "sharphound.exe",
]
# The deployed list adds these names to the built-in one.
EXTRA_DANGEROUS_PROCESSES = ["wevtutil", "wevtutil.exe", "vssadmin", "vssadmin.exe", "crypt0r",
                             "crypt0r.exe"]
UNUSUAL_PORTS = [4444, 5555, 1337, 8888, 9001, 6666, 6667, 31337, 12345]
C2_PORTS = UNUSUAL_PORTS + [8443, 4443, 2222]
C2_RULE_PORTS = [443, 8443, 4444, 5555]
C2_IPS = ["185.220.101.45", "185.220.101.46", "91.92.248.55", "203.0.113.77"]
BAD_HASHES = ["61C0810A23580CF492A6BA4F7654566108331E7A4134C968C2D6A05261B2D8A1"]
LARGE_TRANSFER_BYTES = 10_485_760
PORT_SCAN_THRESHOLD = 15
PORT_SCAN_WINDOW_S = 90
BURST_THRESHOLD = 5
BURST_WINDOW_S = 60

# ---- fixed values: scoring ---------------------------------------------------------------
THRESHOLDS = {"P0": 61, "P1": 41, "P2": 21, "BENIGN": 0}
WEIGHTS = {
    "dangerous_process": 40, "webserver_parent_cmd_child": 35, "c2_port": 30,
    "privilege_escalation_event": 50, "exfiltration_hint_event": 50,
    "ip_historical_correlation": 20, "lsass_access": 50, "encoded_powershell": 35,
    "log_clearing": 60, "shadow_delete": 60, "known_bad_hash": 45, "large_data_transfer": 40,
    "port_scan_detected": 30, "known_c2_ip": 50,
}
QUEUE_P0_TYPES = ["PRIVILEGE_ESCALATION", "EXFILTRATION_HINT", "LATERAL_MOVEMENT_HINT",
                  "AUTHENTICATION_FAILURE_BURST"]
QUEUE_P1_TYPES = ["SERVICE_INSTALL", "SCHEDULED_TASK"]
QUEUE_PRIORITY = {"P0": 0, "P1": 1, "P2": 2, "BENIGN": 3}
QUEUE_MAX_DEPTH = 50

# ---- fixed values: predicates ------------------------------------------------------------
DNS_ENTROPY_THRESHOLD = 3.5
DNS_LABEL_LIMIT = 4
SQL_TOKENS = ["SELECT", "UNION", "DROP", "INSERT", "DELETE", "UPDATE", "EXEC", "EXECUTE", "--",
              "OR 1=1"]
SYSTEM_DIRS = ["system32", "syswow64", "windows/system", "/etc/", "/bin/", "/sbin/",
               "/usr/bin/", "/usr/sbin/", "c:/windows/"]
# IPv4 blocks that count as private, and the two addresses inside them that do not.
PRIVATE_V4 = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
              "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
              "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
PUBLIC_V4_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]
PRIVATE_V6 = ["::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32",
              "2002::/16", "fc00::/7", "fe80::/10"]
PUBLIC_V6_EXCEPTIONS = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
                        "2001:20::/28", "2001:30::/28"]

# ---- fixed values: similarity search -----------------------------------------------------
TEMPORAL_WINDOWS_S = {
    "PRIVILEGE_ESCALATION": 1800, "EXFILTRATION_HINT": 1800, "LATERAL_MOVEMENT_HINT": 1800,
    "PROCESS_CREATION": 3600, "FILE_WRITE": 3600, "AUTHENTICATION_FAILURE_BURST": 3600,
    "NETWORK_CONNECTION": 7200, "HTTP_REQUEST": 7200, "AUTHENTICATION_FAILURE": 14400,
    "DNS_QUERY": 21600,
}
DEFAULT_TEMPORAL_WINDOW_S = 7200
K_NEIGHBORS = 20
SIMILARITY_THRESHOLD = 0.72
HOT_WINDOW_S = 72 * 3600
EMBED_MAX_CHARS = 2000
VOCABULARY_SIZE = 5000

# ---- fixed values: graph -----------------------------------------------------------------
RAW_LOG_SCORE = 5.0
REPORT_SCORES = {"P0": 30.0, "P1": 20.0, "P2": 10.0}
DEFAULT_REPORT_SCORE = 10.0
NODE_COLORS = {"low": "#3498db", "medium": "#f39c12", "high": "#e74c3c"}
NODE_SHAPES = {"ip": "ellipse", "hostname": "round-rectangle", "process": "diamond",
               "user": "triangle", "file": "rectangle"}

# ---- fixed values: reports ---------------------------------------------------------------
MESSAGE_MAX_CHARS = 4096
TACTICS = {
    "TA0001": "Initial Access", "TA0002": "Execution", "TA0003": "Persistence",
    "TA0004": "Privilege Escalation", "TA0005": "Defense Evasion",
    "TA0006": "Credential Access", "TA0007": "Discovery", "TA0008": "Lateral Movement",
    "TA0009": "Collection", "TA0010": "Exfiltration", "TA0011": "Command and Control",
    "TA0040": "Impact",
}
TECHNIQUES = {
    "T1059": "Command and Scripting Interpreter", "T1021": "Remote Services",
    "T1055": "Process Injection", "T1071": "Application Layer Protocol",
    "T1486": "Data Encrypted for Impact", "T1003": "OS Credential Dumping",
    "T1105": "Ingress Tool Transfer", "T1543": "Create or Modify System Process",
    "T1505": "Server Software Component", "T1190": "Exploit Public-Facing Application",
    "T1046": "Network Service Discovery", "T1053": "Scheduled Task/Job",
    "T1547": "Boot or Logon Autostart Execution", "T1490": "Inhibit System Recovery",
    "T1070": "Indicator Removal", "T1562": "Impair Defenses",
    "T1041": "Exfiltration Over C2 Channel",
    "T1048": "Exfiltration Over Alternative Protocol",
}

# ---- fixed values: retrieval stop words (a parameter of the job; this is the default) ----
STOP_WORDS = (
    "about above after again against all am an and any are as at be because been before being "
    "below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how if in into is it "
    "its itself just me more most my myself no nor not now of off on once only or other our "
    "ours ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we "
    "were what when where which while who whom why will with would you your yours yourself "
    "yourselves"
).split()

DEAD_LETTER_MAX_RETRIES = 3
DEAD_LETTER_MIN_AGE_S = 300


@dataclass(frozen=True)
class ThreatConfig:
    """Lists, thresholds and weights of the triage score; every part may be replaced."""

    dangerous_processes: tuple[str, ...] = tuple(DANGEROUS_PROCESSES)
    c2_ports: tuple[int, ...] = tuple(C2_PORTS)
    known_c2_ips: tuple[str, ...] = tuple(C2_IPS)
    known_bad_hashes: tuple[str, ...] = tuple(BAD_HASHES)
    severity_thresholds: Mapping[str, int] = field(default_factory=lambda: dict(THRESHOLDS))
    scoring_weights: Mapping[str, int] = field(default_factory=lambda: dict(WEIGHTS))

    def override(self, **given) -> "ThreatConfig":
        """A given list replaces the default; a weight or threshold left out keeps its default."""
        for name, defaults in (("severity_thresholds", THRESHOLDS), ("scoring_weights", WEIGHTS)):
            if name in given:
                given[name] = {**defaults, **given[name]}
        for name in ("dangerous_processes", "c2_ports", "known_c2_ips", "known_bad_hashes"):
            if name in given:
                given[name] = tuple(given[name])
        return replace(self, **given)


def _pairs(spark: SparkSession, mapping: Mapping, schema: str) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), schema)


def event_code_dim(spark: SparkSession, extra_windows: bool = False) -> DataFrame:
    """(source, code, mapped_type) for both code maps."""
    codes = {source: dict(pairs) for source, pairs in EVENT_CODES.items()}
    if extra_windows:
        codes["windows_event"].update(EXTRA_WINDOWS_CODES)
    rows = [(s, c, t) for s, pairs in codes.items() for c, t in pairs.items()]
    return spark.createDataFrame(rows, "source string, code string, mapped_type string")


def temporal_window_dim(spark: SparkSession, windows: Mapping[str, int] | None = None) -> DataFrame:
    return _pairs(spark, TEMPORAL_WINDOWS_S if windows is None else windows,
                  "event_type string, window_s int")


def tactic_dim(spark: SparkSession) -> DataFrame:
    return _pairs(spark, TACTICS, "mitre_id string, mitre_name string")


def technique_dim(spark: SparkSession) -> DataFrame:
    return _pairs(spark, TECHNIQUES, "mitre_id string, mitre_name string")


def values_dim(spark: SparkSession, values, schema: str) -> DataFrame:
    """A one-column list (ports, addresses, hashes, names) as a frame."""
    return spark.createDataFrame([(v,) for v in values], schema)
