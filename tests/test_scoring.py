"""Scores, queue order, dead letters, reports and validation against known answers."""

from pyspark.sql import functions as F

from vigilark import dims
from vigilark.operators import deadletters, queueing, reports, severity, validate
from vigilark.plans import derive

COLUMNS = ("process_name", "parent_process_name", "command_line_args", "source_ip", "dest_ip",
           "event_code", "mitre_technique_hint", "severity_hint")


def rows(spark, *given):
    base = spark.createDataFrame(
        [(str(i), g.get("event_type", "UNKNOWN"), g.get("dest_port"), g.get("bytes_sent"),
          g.get("raw_payload", ""), g.get("synthetic_intent", ""), *[g.get(c) for c in COLUMNS])
         for i, g in enumerate(given)],
        "log_uuid string, event_type string, dest_port int, bytes_sent bigint, raw_payload string, "
        "synthetic_intent string, " + ", ".join(f"{c} string" for c in COLUMNS))
    return base


def test_triage_known_answers(spark):
    got = severity.triage_score(rows(
        spark, {"dest_port": 4444}, {"event_type": "PRIVILEGE_ESCALATION"},
        {"event_type": "EXFILTRATION_HINT", "event_code": "1102"},
        {"process_name": "C:\\x\\MIMIKATZ.exe"}, {"bytes_sent": 10_485_760}, {"bytes_sent": 10_485_761},
        {"raw_payload": f"..{dims.BAD_HASHES[0].lower()}.."}, {"source_ip": "91.92.248.55"},
        {"parent_process_name": "NGINX", "process_name": "Bash"}, {},
        {"process_name": "powershell.exe", "command_line_args": "-EncodedCommand x"})).orderBy(
        F.col("log_uuid").cast("int")).collect()
    assert [(r.score, r.triage_severity) for r in got] == [
        (30, "P2"), (50, "P1"), (110, "P0"), (40, "P2"), (0, "BENIGN"), (40, "P2"), (45, "P1"),
        (50, "P1"), (35, "P2"), (0, "BENIGN"), (35, "P2")]
    assert got[0].heuristic_flags == ["c2_port:4444"] and got[0].confidence == 0.3
    assert got[8].heuristic_flags == ["webshell:nginx->bash"]
    assert got[1].correlation_required and not got[0].correlation_required


def test_override_keeps_unnamed_weights():
    config = dims.ThreatConfig().override(scoring_weights={"c2_port": 1}, c2_ports=[22])
    assert config.scoring_weights["c2_port"] == 1 and config.scoring_weights["lsass_access"] == 50
    assert config.c2_ports == (22,) and config.known_c2_ips == tuple(dims.C2_IPS)


def test_queue_severity_order_of_rules(spark):
    got = severity.queue_severity(rows(
        spark, {"event_type": "LATERAL_MOVEMENT_HINT", "severity_hint": "BENIGN"},
        {"event_type": "SERVICE_INSTALL"}, {"event_type": "NETWORK_CONNECTION", "dest_port": 31337},
        {"mitre_technique_hint": "T1", "severity_hint": "P0"}, {"severity_hint": "P0"}, {})).orderBy(
        "log_uuid").collect()
    assert [(r.severity, r.priority) for r in got] == [
        ("P0", 0), ("P1", 1), ("P1", 1), ("P2", 2), ("P0", 0), ("BENIGN", 3)]


def test_full_paths_match_only_when_asked(spark):
    given = rows(spark, {"event_type": "PROCESS_CREATION", "process_name": "C:\\Windows\\CMD.exe",
                         "parent_process_name": "/usr/sbin/nginx"})
    assert severity.queue_severity(given).first().severity == "BENIGN"
    assert severity.queue_severity(given, basename=True).first().severity == "P1"
    assert severity.triage_score(given).first().score == 0
    assert severity.triage_score(given, basename=True).first().score == 35


def test_shedding_equals_the_loop(spark, folder):
    import random
    rng = random.Random(42)
    given = [(f"u{i:05d}", i // 700, rng.choice(["P0", "P1", "P2", "P2", "BENIGN"])) for i in range(2000)]
    frame = spark.createDataFrame(given, "log_uuid string, minute int, severity string").withColumn(
        "event_timestamp", F.timestamp_seconds(F.col("minute") * 60))
    got = {r.log_uuid for r in queueing.shed_load(frame, "1 minute", 200).filter("dropped").collect()}
    want, depth = set(), {}
    for uuid, minute, level in sorted(given, key=lambda g: (g[1], g[0])):
        if depth.get(minute, 0) >= 200 and level == "P2":
            want.add(uuid)
        else:
            depth[minute] = depth.get(minute, 0) + 1
    assert got == want and want
    stats = queueing.queue_stats(queueing.shed_load(frame, "1 minute", 200), 200).first()
    assert (stats.depth, stats.total_dropped) == (max(depth.values()), len(want))


def test_top_k_is_cut_before_the_shuffle(spark, folder):
    shed = queueing.shed_load(derive.sec_log(spark, folder).withColumn("severity", F.lit("P2")))
    assert "WindowGroupLimit" in shed._jdf.queryExecution().executedPlan().toString()


def test_retry_and_escalation(spark):
    letters = spark.createDataFrame([
        ("a", "W", '{"log_uuid":"x","event_type":"DNS_QUERY"}', "r", "2024-01-01T00:00:00Z", 0, False),
        ("b", "W", "{}", "r", "2024-01-01T09:58:00Z", 1, False),
        ("c", "W", "{}", "r", "garbage", 2, False), ("d", "W", "{}", "r", "2024-01-01T00:00:00Z", 3, False),
        ("e", "W", "{}", "r", "2024-01-01T00:00:00Z", 0, True), ("f", "W", "oops", "r", "10:00:00", 0, False),
    ], "dlq_uuid string, work_type string, payload string, failure_reason string, failed_at string, "
       "retry_count int, resolved boolean")
    now = F.lit("2024-01-01 10:00:00").cast("timestamp")
    assert {r.dlq_uuid for r in deadletters.eligible(letters, now).collect()} == {"a", "c", "f"}
    again, after = deadletters.retry_pass(letters, now)
    assert {(r.log_uuid, r.event_type, r.severity) for r in again.collect()} == {
        ("x", "DNS_QUERY", "P1"), ("c", "UNKNOWN", "P1")}
    assert {r.dlq_uuid: r.retry_count for r in after.collect()} == {
        "a": 1, "b": 1, "c": 3, "d": 3, "e": 0, "f": 0}
    twice = letters.filter("dlq_uuid = 'a'").unionByName(letters.filter("dlq_uuid = 'a'"))
    assert [r.retry_count for r in deadletters.retry_pass(twice, now)[1].collect()] == [1, 1]
    assert [(r.dlq_uuid, r.log_uuid) for r in deadletters.escalations(letters).collect()] == [("d", "unknown")]


def test_responses(spark):
    good = '{"narrative":"n","confidence":0.5,"entities":[{"type":"ip","value":"1"}]}'
    texts = [good, f"say\n```json\n{good}\n```", f"```\n{good}\n```\n```\n{{}}\n```", "```json\n{}\n```",
             '{"properties":{}}', '{"narrative":"n","confidence":1.2}', '{"narrative":"n","confidence":0.5} x',
             '{"narrative":"n","confidence":0.5,"entities":[{"type":"ip"}]}',
             '{"narrative":"n","confidence":0.5,"mitre_tactics":"TA1"}', "[]"]
    frame = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate(texts)],
                                  "trigger_id string, attempt int, response string")
    got = {int(r.trigger_id): (r.problem, r.report) for r in reports.parse_responses(frame).collect()}
    assert [got[i][0] for i in range(10)] == [
        None, None, None, "narrative missing", "schema instead of data", "confidence outside 0 to 1",
        "not one JSON object", "malformed list", "malformed list", "not one JSON object"]
    assert got[1][1].entities[0].value == "1"


def test_violations_and_quarantine_agree(spark, folder):
    frame = derive.sec_log(spark, folder).withColumn(
        "event_type", F.when(F.col("event_id") % 50 == 0, "ODD").otherwise(F.col("event_type")))
    total = validate.violations(frame).agg(F.sum("n_violations")).first()[0]
    good, bad = validate.quarantine(frame)
    assert total == bad.count() == 20 and good.count() + 20 == frame.count()


def test_hash_inside_a_longer_run(spark):
    digest = "AB" * 32
    rows = spark.createDataFrame([("a", f"x {digest.lower()} y"), ("b", f"00{digest}ff"), ("c", digest[:-1])],
                                 "log_uuid string, raw_payload string")
    hashes = spark.createDataFrame([(digest.lower(),)], "hash string")
    from vigilark.operators import severity as rules
    assert {r.log_uuid for r in rules.bad_hash_matches(rows, hashes).collect()} == {"a", "b"}


def test_routes_and_handoff(spark):
    from vigilark.operators import severity as rules
    triaged = spark.createDataFrame([("a", "P0"), ("b", "P1"), ("c", "P2"), ("d", "BENIGN")], "log_uuid string, triage_severity string")
    routes = {name: {r.log_uuid for r in rows.collect()} for name, rows in rules.triage_routes(triaged).items()}
    assert routes == {"stop": {"d"}, "report_only": {"c"}, "correlate": {"a", "b"}}
    stage = spark.createDataFrame([("a", "triage", "1"), ("b", "triage", "0"), ("c", None, "1")],
                                  "log_uuid string, from_skill string, schema_version string")
    accepted, letters = rules.handoff_gate(stage, "triage", version="1")
    assert [r.log_uuid for r in accepted.collect()] == ["a"]
    assert {r.failure_reason for r in letters.collect()} == {"schema_version_mismatch", "invalid_manifest"}
