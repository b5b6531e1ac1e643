"""Streams against their batch forms, one micro-batch per input file."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vigilark.operators import activity, graph, normalize
from vigilark.plans import derive
from vigilark.plans.stages import canonical_rows, triaged_rows
from vigilark.sources.lines import scan_lines
from vigilark.streaming import graph_log, jobs


@pytest.fixture(scope="module")
def feed(spark, folder, tmp_path_factory):
    """Rows in time order, a few files written one after the other, replayed as a stream."""
    path = str(tmp_path_factory.mktemp("feed") / "rows")
    rows = derive.sec_log(spark, folder).withColumn("severity", F.lit("P2"))
    size = rows.count() / 4
    # The file source takes files by age, so each file must be older than the next.
    for part in range(4):
        rows.filter(F.floor(F.col("event_id") / size) == part).coalesce(1).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stored, stream


def collect_stream(spark, frame, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    query = (frame.writeStream.format("parquet").outputMode(mode).option("path", out)
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    return spark.read.schema(frame.schema).parquet(out)


def test_hourly_activity(spark, feed, tmp_path):
    stored, stream = feed
    got = {(r.hour_start, r.ip): r.n for r in
           collect_stream(spark, jobs.hourly_activity(stream), tmp_path).collect()}
    want = {(r.hour_start, r.ip): r.n for r in jobs.hourly_activity(stored).collect()}
    # Windows above the final watermark stay open; the closed ones must agree.
    assert got and got.items() <= want.items()
    assert len(want) - len(got) <= 20


def test_sliding_scans_and_sessions(spark, feed, tmp_path):
    stored, stream = feed
    run = lambda rows: jobs.sliding_scans(rows, "2 days", "1 day", threshold=3)
    got = {tuple(r) for r in collect_stream(spark, run(stream), tmp_path / "a").collect()}
    assert got and got <= {tuple(r) for r in run(stored).collect()}
    run = lambda rows: jobs.host_sessions(rows, "3 hours")
    batch = activity.host_sessions(stored, gap_s=3 * 3600)
    spans = {(r.hostname, r.session_start): (r.session_end, r.span_minutes, r.n_events) for r in batch.collect()}
    streamed = {(r.hostname, r.session_start): (r.session_end, r.span_minutes, r.n_events) for r in run(stored).collect()}
    assert len(streamed) >= len(spans) and sum(spans.get(k) == v for k, v in streamed.items()) >= 0.9 * len(streamed)
    got = {tuple(r) for r in collect_stream(spark, run(stream), tmp_path / "b").collect()}
    assert got and got <= {tuple(r) for r in run(stored).collect()}


def test_duplicates_are_dropped(spark, feed, tmp_path):
    stored, stream = feed
    doubled = jobs.unique_rows(stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))))
    got = collect_stream(spark, doubled.select("log_uuid"), tmp_path)
    assert got.count() == stored.count() == got.distinct().count()


def test_burst_then_success(spark, feed, tmp_path):
    stored, stream = feed

    def run(rows):
        bursts = rows.filter("event_type = 'AUTHENTICATION_FAILURE'").select(
            "user_account", F.col("event_timestamp").alias("burst_time"))
        return jobs.burst_then_success(bursts, rows, within="12 hours")

    got = {tuple(r) for r in collect_stream(spark, run(stream), tmp_path).collect()}
    assert got and got == {tuple(r) for r in run(stored).collect()}


NODE_COLUMNS = ["id", "type", "label", "threat_score", "first_seen", "last_seen", "touches", "risk_level"]


def graph_rows(nodes, edges):
    return {tuple(r) for r in nodes.select(NODE_COLUMNS).collect()}, {tuple(r) for r in edges.select("id", "timestamp", "label").collect()}


def test_graph_log_equals_one_batch(spark, feed, tmp_path):
    """Before, between and after compactions, and when a batch comes again."""
    stored, _ = feed
    base = str(tmp_path / "graph")
    update = graph_log.updates(base, buckets=3)
    parts = [stored.filter(F.floor(F.col("event_id") / (stored.count() / 4)) == p) for p in range(4)]
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "graph").rglob("*.parquet") if "runs" in f.parts)
    written = []
    for number, part in enumerate(parts):
        update(part, number)
        written.append(size())
        want = stored.filter(F.floor(F.col("event_id") / (stored.count() / 4)) <= number)
        if number == 1:
            before = graph_rows(graph_log.nodes(spark, base), graph_log.edges(spark, base))
            assert graph_log.compact(spark, base) == {"nodes": [0, 1, 2], "edges": [0, 1, 2]}
            assert graph_log.compact(spark, base) == {"nodes": [], "edges": []}
            assert graph_rows(graph_log.nodes(spark, base), graph_log.edges(spark, base)) == before
        if number == 2:
            delta = {tuple(r) for r in spark.read.parquet(f"{base}/delta/v2").collect()}
            update(part, 2)
            assert delta == {tuple(r) for r in spark.read.parquet(f"{base}/delta/v2").collect()}
            assert size() == written[-1]
        assert graph_rows(graph_log.nodes(spark, base), graph_log.edges(spark, base)) == graph_rows(
            graph.build_nodes(graph.log_node_parts(want)), graph.build_edges(graph.log_edge_parts(want)))
    # A run grows with its batch, not with the table.
    runs = [b - a for a, b in zip([0, *written], written)]
    assert max(runs) < 1.5 * min(runs)
    assert graph_rows(graph_log.nodes(spark, base, before=2), graph_log.edges(spark, base, before=2)) == before


def test_graph_log_from_a_stream(spark, feed, tmp_path):
    stored, stream = feed
    base = str(tmp_path / "graph")
    jobs.run_batches(stream, graph_log.updates(base), str(tmp_path / "cp")).awaitTermination(240)
    assert graph_rows(graph_log.nodes(spark, base), graph_log.edges(spark, base)) == graph_rows(
        graph.build_nodes(graph.log_node_parts(stored)), graph.build_edges(graph.log_edge_parts(stored)))


def test_late_rows_are_kept(spark, tmp_path):
    source = tmp_path / "in"
    schema = "log_uuid string, event_timestamp timestamp"
    for i, rows in enumerate([[("a", "2024-01-02 00:00:00")],
                              [("b", "2024-01-01 00:00:00"), ("c", "2024-01-02 01:00:00")]]):
        spark.createDataFrame(rows, "log_uuid string, t string").selectExpr(
            "log_uuid", "cast(t AS timestamp) AS event_timestamp").coalesce(1).write.mode(
            "append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        jobs.run_batches(stream, jobs.late_rows(str(tmp_path / "out"), 3600),
                         str(tmp_path / "cp")).awaitTermination(60)
    assert [r.log_uuid for r in spark.read.schema(schema).parquet(str(tmp_path / "out/late/v1")).collect()] == ["b"]


def test_ingest_from_files(spark, tmp_path):
    source = tmp_path / "logs"
    source.mkdir()
    good = {"event_type": "privilege_escalation", "hostname": "h", "timestamp": "2024-01-01T00:00:00Z"}
    (source / "one.log").write_text(json.dumps(good) + "\n" + json.dumps(good) + "\n\n")
    run = lambda: jobs.ingest(spark, str(source), str(tmp_path / "arch"), str(tmp_path / "dlq"),
                              str(tmp_path / "cp")).awaitTermination(120)
    run()
    (source / "two.log").write_text('{"event_type": 5}\nplain\n')
    run()
    stored = spark.read.parquet(str(tmp_path / "arch"))
    # The failed line is stored as its minimal row as well.
    assert stored.count() == 4 and stored.select("log_uuid").distinct().count() == 4
    assert "heuristic_flags" in stored.columns
    assert {r.triage_severity for r in stored.collect()} == {"P1", "BENIGN"}
    totals = {r.metric: r.n for r in spark.read.parquet(str(tmp_path / "cp-activity/totals")).groupBy("metric").agg(F.sum("value").alias("n")).collect()}
    assert (totals["ingested"], totals["dead_letters"], totals["p1"]) == (4, 1, 2) and totals["benign"] == 2
    letters = spark.read.parquet(str(tmp_path / "dlq"))
    assert letters.count() == 1 and "event_type" in letters.first().payload


def test_ingest_scores_know_earlier_batches(spark, tmp_path):
    """The stored scores are those of all lines at once: sightings and scans reach over files and a restart."""
    source, rng = tmp_path / "logs", random.Random(6)
    source.mkdir()
    for part in range(3):
        lines = []
        for i in range(60):
            at = f"2024-01-01T{3 + part * 2 + i // 30:02d}:{i % 30:02d}:{rng.randint(0, 59):02d}"
            ip = rng.choice(["9.9.9.9", "9.9.9.9", f"8.8.{part}.{i}", "7.7.7.7"])
            # The last line of a file and the first ones of the next are one scan.
            deny = i < 4 or i > 55
            lines.append(f'date="{at}" action={"DENY" if deny else "ALLOW"} src={"6.6.6.6" if deny else ip} dst=10.0.0.{i} dport=4444'
                         if i % 3 or deny else json.dumps({"event_type": "network_connection", "timestamp": at + "Z", "source_ip": ip, "dest_ip": ""}))
        (source / f"firewall{part}.log").write_text("\n".join(lines) + "\n")
        scan = {"window_s": 2 * 3600, "threshold": 7}
        jobs.ingest(spark, str(source), str(tmp_path / "arch"), str(tmp_path / "dlq"), str(tmp_path / "cp"),
                    scan=scan).awaitTermination(240)
    columns = ["log_uuid", "score", "ip_seen", "scan_count", "triage_severity", F.array_join("heuristic_flags", ",").alias("flags")]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "arch")).select(columns).collect()}
    lines = normalize.assign_uuids(scan_lines(spark, str(source)))
    want = {tuple(r) for r in triaged_rows(canonical_rows(lines, with_action=True), scan=scan).select(columns).collect()}
    assert got == want and len(want) == 180
    assert {r[2] for r in want} == {True, False} and max(r[3] for r in want) > 4 and any("port_scan" in r[5] for r in want)


def test_sliding_bursts(spark, tmp_path):
    rows = spark.createDataFrame(
        [("u", "1.1.1.1", "h", "AUTHENTICATION_FAILURE", f"2024-01-01 00:00:{s:02d}") for s in range(0, 30, 5)]
        + [("v", "1.1.1.1", "h", "AUTHENTICATION_FAILURE", "2024-01-01 00:00:00"), ("u", "1.1.1.1", "h", "DNS_QUERY", "2024-01-01 09:00:00")],
        "user_account string, source_ip string, hostname string, event_type string, t string").withColumn(
        "event_timestamp", F.col("t").cast("timestamp"))
    found = jobs.sliding_bursts(rows, threshold=5).collect()
    assert {r.user_account for r in found} == {"u"} and max(r.n for r in found) == 6


def test_scheduled_passes(spark, tmp_path):
    letters = spark.createDataFrame(
        [("a", "W", '{"event_type":"DNS_QUERY"}', "r", "2024-01-01T00:00:00Z", 0, False),
         ("a", "W", '{"event_type":"DNS_QUERY"}', "r", "2024-01-01T00:00:00Z", 0, False)],
        "dlq_uuid string, work_type string, payload string, failure_reason string, failed_at string, retry_count int, resolved boolean")
    letters.write.parquet(f"{tmp_path}/letters")
    jobs.retry_letters(spark, f"{tmp_path}/letters", f"{tmp_path}/after", f"{tmp_path}/queue", "2024-01-01 10:00:00")
    assert [r.retry_count for r in spark.read.parquet(f"{tmp_path}/after").collect()] == [1, 1]
    jobs.retry_letters(spark, f"{tmp_path}/letters", f"{tmp_path}/after", f"{tmp_path}/queue", "2024-01-01 10:00:00")
    assert spark.read.parquet(f"{tmp_path}/queue").count() == 2
    rows = spark.createDataFrame([("old", 0.0, [1.0]), ("new", 9e5, [2.0])], "id string, event_epoch double, embedding array<double>")
    rows.write.parquet(f"{tmp_path}/active")
    rows.limit(0).write.parquet(f"{tmp_path}/cold")
    jobs.move_tiers(spark, f"{tmp_path}/active", f"{tmp_path}/cold", f"{tmp_path}/next", hot_s=3600)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/next/archive").collect()] == [("old", 0.0, [1.0])]
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/next/active").collect()] == ["new"]


def test_a_quiet_day_is_one_file(spark, folder, tmp_path):
    from vigilark.sources import archive
    archive.append_archive(derive.sec_log(spark, folder), str(tmp_path / "arch"))
    files = list((tmp_path / "arch").glob("event_date=*/*.parquet"))
    assert len(files) == len(list((tmp_path / "arch").glob("event_date=*")))
