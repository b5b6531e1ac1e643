"""Parsing, identification, normalising and the line sources."""

import random

from pyspark.sql import functions as F

from vigilark.operators import enrich, normalize, parse
from vigilark.sources import archive, lines

ROWS = [
    ('{"EventID":4625,"TimeCreated":"2024-01-01T00:00:00Z","TargetUserName":"","IpPort":"80"}', "/x/a.json"),
    ('{"source":"sysmon","EventID":10,"SourceImage":"C:\\\\t\\\\m.exe","hostname":null,"Computer":"C1"}', "/x/a.json"),
    ('{"ts":1746612000.5,"query":"abc.def"}', "/zeek/dns.log"),
    ("{'a':1}", "/x/a.json"), ('{"a":1} tail', "/x/a.json"), ('{"a":1},{"b":2}', "/x/a.json"),
    ('{"a":NaN}', "/x/a.json"), ("[1,2]", "/x/a.json"),
    (' a=1 b="x y" c="" d=é ', "/x/ufw.log"), ("<34>Oct 11 22:14:15 host su: x", "/x/b"),
    ("   ", "/x/b"), ('{"event_type":7}', "/x/b"), ('{"event_type":"dns_query","severity":"high"}', "/x/b"),
    ('{"EventID":1,"Image":"C:\\\\a.exe"}', "/sysmon/ops.json"),
]


def frame(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)],
                                 "n int, line string, source_path string")


def test_formats_and_sources(spark):
    rows = {r.n: r for r in parse.identify_source(parse.parse_lines(frame(spark))).collect()}
    assert [rows[i].format for i in range(14)] == [
        "json", "json", "json", "raw", "raw", "raw", "raw", "raw", "kv", "syslog", "empty",
        "json", "json", "json"]
    assert rows[8].fields == {"a": "1", "b": "x y", "c": "", "d": "é"}
    assert rows[2].numeric_keys == ["ts"] and rows[0].numeric_keys == []
    assert [rows[i].log_source for i in (0, 1, 2, 8, 9, 13)] == [
        "windows_event", "sysmon", "zeek_dns", "firewall", "unknown", "windows_event"]


def test_sysmon_path_option(spark):
    found = parse.identify_source(parse.parse_lines(frame(spark)), sysmon_path_wins=True)
    assert found.filter("n = 13").first().log_source == "sysmon"
    assert found.filter("n = 0").first().log_source == "windows_event"


def test_normalized_rows(spark):
    out = normalize.normalize(parse.identify_source(parse.parse_lines(frame(spark))), keep=("n",))
    rows = {r.n: r for r in out.collect()}
    assert 10 not in rows
    assert rows[0].event_type == "AUTHENTICATION_FAILURE" and rows[0].user_account is None
    assert rows[0].source_port == 80 and rows[0].process_name == "windows_event"
    # A present null host blocks the next key and reads as the placeholder.
    assert rows[1].hostname == "unknown_host" and rows[1].process_name == "m.exe"
    assert rows[1].command_line_args == "GrantedAccess:? Target:?"
    assert rows[2].event_timestamp_raw == "2025-05-07T10:00:00.500000+00:00"
    assert rows[11].normalize_failed and rows[11].event_type == "UNKNOWN"
    assert rows[12].event_type == "DNS_QUERY" and rows[12].severity_hint is None
    assert rows[13].event_type == "UNKNOWN" and rows[13].event_code == "1"


def test_copies_get_distinct_repeatable_uuids(spark):
    copies = spark.createDataFrame(
        [("p", "same", b) for b in (0, 0, 0, 100, 100, 200)] + [("p", "other", 0), ("q", "same", 0)],
        "source_path string, line string, block_start bigint")
    once = sorted(r.log_uuid for r in normalize.assign_uuids(copies).collect())
    again = sorted(r.log_uuid for r in normalize.assign_uuids(copies.repartition(3)).collect())
    assert len(set(once)) == 8 and once == again


def test_scan_and_phases(spark, tmp_path):
    body = "# === PHASE 1: start ===\n{\"a\":1}\n# note\n\nbad\n# === PHASE 2 ===\n{\"b\":2}\n{\"c\":3}\n"
    (tmp_path / "one.log").write_text(body)
    assert lines.scan_lines(spark, str(tmp_path)).count() == 7
    numbered = lines.scan_scenarios(spark, str(tmp_path))
    for block in (2, 100):
        got = [(r.phase, r.line) for r in
               lines.label_phases(numbered, block_lines=block).orderBy("line_no").collect()]
        assert got == [("PHASE 1: start", '{"a":1}'), ("PHASE 2", '{"b":2}'), ("PHASE 2", '{"c":3}')]


def test_archive_lookup_prunes_and_pushes(spark, tmp_path, folder):
    from vigilark.plans import derive
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    path = str(tmp_path / "archive")
    archive.append_archive(derive.sec_log(spark, folder).select(
        "log_uuid", "event_timestamp", "source_ip", "process_name"), path)
    found = archive.lookup(archive.read_archive(spark, path), "2024-01-05", "2024-01-06",
                           source_ip="10.0.1.1")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "EqualTo(source_ip" in plan


def test_sentences(spark):
    rows = spark.createDataFrame([
        (1, "PROCESS_CREATION", "cmd.exe", "NGINX", "wevtutil cl System", None, None),
        (2, "PRIVILEGE_ESCALATION", "LSASS.exe", None, None, None, None),
        (3, "REGISTRY_WRITE", "reg.exe", None, None, r"HKLM\Run\DisableAntiSpyware", None),
        (4, "NETWORK_CONNECTION", "p", None, None, None, "203.0.113.77"),
        (5, "FILE_DELETE", "p", None, None, None, None),
    ], "n int, event_type string, process_name string, parent_process_name string, "
       "command_line_args string, registry_key string, dest_ip string")
    for name in ("hostname", "user_account", "source_ip", "dns_query", "http_url", "http_method",
                 "file_path", "event_code", "event_timestamp_raw", "mitre_technique_hint"):
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    rows = rows.withColumn("source_port", F.lit(None).cast("int")).withColumn(
        "dest_port", F.lit(443))
    got = {r.n: r for r in enrich.enrich(rows).collect()}
    assert got[1].mitre_technique_hint == "T1505.003"
    assert "Event log cleared via wevtutil." in got[1].synthetic_intent
    assert got[2].mitre_technique_hint == "T1003.001"
    assert got[3].mitre_technique_hint == "T1562.001"
    assert got[4].mitre_technique_hint == "T1021" and "HTTPS" in got[4].synthetic_intent
    assert got[5].synthetic_intent.endswith("at unknown. Raw event code: unknown.")


def test_lines_of_many_splits_are_numbered(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for name, n in (("a.log", 900), ("b.log", 3), ("c.log", 0), ("d.log", 400)):
        held = [rng.choice(["", "# === PHASE x ===", '{"a": 1}', "é" * rng.randint(1, 90), "x\ry", " \r"]) for _ in range(n)]
        (tmp_path / name).write_bytes(("\n".join(held) + "\n" * (n > 3)).encode())
        want |= {(name, i): line for i, line in enumerate(held)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    try:
        found = lines.scan_scenarios(spark, str(tmp_path))
        got = {(r.source_path.rsplit("/", 1)[1], r.line_no): r.line for r in found.collect()}
        assert got == want
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
