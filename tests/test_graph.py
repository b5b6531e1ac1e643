"""Entity graph known answers."""

from pyspark.sql import functions as F

from vigilark.operators import graph
from vigilark.schema import ENTITIES


def report(spark, entities, severity="P0", technique="T1059", report_id="r1"):
    return spark.createDataFrame(
        [(report_id, severity, [technique], [(t, v, "") for t, v in entities])],
        f"report_id string, severity string, mitre_techniques array<string>, entities {ENTITIES}"
    ).withColumn("report_time", F.lit("2024-01-01").cast("timestamp"))


SEVEN = [("ip", "1.1.1.1"), ("hostname", "Web 01"), ("process", "cmd.exe"), ("user", "bob"),
         ("file", "/tmp/x"), ("ip", "2.2.2.2"), ("process", "nginx")]


def test_new_then_repeated_report(spark):
    told = report(spark, SEVEN)
    parts, edges = graph.report_node_parts(told), graph.report_edge_parts(told)
    nodes, edge_table = graph.build_nodes(parts), graph.build_edges(edges)
    assert nodes.count() == 7 and edge_table.count() == 21
    assert {r.threat_score for r in nodes.collect()} == {30.0}
    assert nodes.filter("id = 'hostname:web_01' AND risk_level = 'medium'").count() == 1
    again = report(spark, SEVEN, "P1", report_id="r2")
    changes = graph.delta(nodes, edge_table, graph.report_node_parts(again), graph.report_edge_parts(again))
    assert {r.kind: r["count"] for r in changes.groupBy("kind").count().collect()} == {"updated_node": 7}
    merged = graph.merge_nodes(nodes, graph.report_node_parts(again))
    assert {r.threat_score for r in merged.collect()} == {50.0}
    kinds = {(r.source, r.target): r.type for r in edge_table.collect()}
    assert kinds["ip:1.1.1.1", "ip:2.2.2.2"] == "network_connection"
    assert kinds["ip:1.1.1.1", "process:cmd.exe"] == "process_spawn"
    assert kinds["ip:1.1.1.1", "hostname:web_01"] == "interaction"


def test_repeated_entities_make_the_listed_pairs(spark):
    entities = [("ip", "a"), ("user", "b"), ("ip", "a"), ("file", ""), ("user", "c"), ("user", "b")]
    named = [f"{t}:{v}" for t, v in entities if v]
    got = {(r.source, r.target) for r in graph.report_edge_parts(report(spark, entities)).collect()}
    assert got == {(named[i], named[j]) for i in range(len(named)) for j in range(i + 1, len(named))}


def test_twenty_rows_one_edge_and_the_cap(spark):
    rows = spark.range(25).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("log_uuid"),
        F.timestamp_seconds("id").alias("event_timestamp"), F.lit("H").alias("hostname"),
        F.lit("10.0.0.1").alias("source_ip"), F.lit(None).cast("string").alias("dest_ip"),
        F.lit("").alias("process_name"), F.lit(None).cast("string").alias("user_account"))
    nodes = graph.build_nodes(graph.log_node_parts(rows))
    assert {(r.id, r.threat_score, r.risk_level) for r in nodes.collect()} == {
        ("hostname:h", 100.0, "high"), ("ip:10.0.0.1", 100.0, "high")}
    assert [r.id for r in graph.build_edges(graph.log_edge_parts(rows)).collect()] == [
        "e_hostname:h_ip:10.0.0.1_has_interface"]


def test_placeholder_host_is_a_node_only_through_an_edge(spark):
    rows = spark.createDataFrame(
        [("a", "unknown_host", "1.1.1.1"), ("b", "unknown_host", None)],
        "log_uuid string, hostname string, source_ip string").withColumn(
        "event_timestamp", F.lit("2024-01-01").cast("timestamp"))
    for name in ("dest_ip", "process_name", "user_account"):
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    nodes = {r.id: (r.threat_score, r.touches) for r in graph.build_nodes(graph.log_node_parts(rows)).collect()}
    assert nodes == {"hostname:unknown_host": (0.0, 1), "ip:1.1.1.1": (5.0, 2)}
    levels = spark.createDataFrame([(29.0,), (30.0,), (60.0,), (61.0,)], "s double").select(
        graph.risk_level(F.col("s")).alias("l"))
    assert [r.l for r in levels.collect()] == ["low", "medium", "medium", "high"]
