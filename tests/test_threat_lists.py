"""Lists from tables: the same score as with lists in the plan, for lists of any length."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.operators import severity
from vigilark.plans.queries import _enriched
from vigilark.sources import threat_lists


def scores(rows):
    return {(r.log_uuid, r.score, r.triage_severity, tuple(r.heuristic_flags)) for r in rows.collect()}


@pytest.fixture(scope="module")
def rows(spark, folder):
    return _enriched(spark, folder)


def test_score_through_joins_is_the_score(spark, rows):
    some = [r.dest_ip for r in rows.filter("dest_ip is not null").select("dest_ip").distinct().orderBy("dest_ip").limit(5).collect()]
    config = dims.ThreatConfig().override(known_c2_ips=some, dangerous_processes=["powershell", "", "CMD", "no such"])
    lists = threat_lists.of_config(spark, config)
    got, want = scores(severity.triage_score(threat_lists.with_list_hits(rows, lists), config)), scores(severity.triage_score(rows, config))
    assert got == want
    flags = {f.split(":")[0] for r in want for f in r[3]}
    assert {"dangerous_process", "known_c2_ip"} <= flags


def test_every_list_from_a_table(spark, tmp_path):
    bad = hashlib.sha256(b"x").hexdigest()
    table = [("bad_hash", None, bad), ("c2_ip", None, "9.9.9.9"), ("dangerous_process", None, "Evil"), ("c2_port", None, "77"),
             ("weight", "known_c2_ip", "7"), ("threshold", "P2", "5"), ("window", "DNS_QUERY", "60")]
    (tmp_path / "lists.json").write_text("\n".join(json.dumps(dict(zip(("kind", "name", "value"), r))) for r in table))
    lists = threat_lists.load(spark, str(tmp_path / "lists.json"), "json")
    assert lists.config.c2_ports == (77,) and lists.windows["DNS_QUERY"] == 60 and lists.windows["FILE_WRITE"] == 3600
    columns = ("log_uuid string, process_name string, raw_payload string, source_ip string, dest_ip string, event_type string, dest_port int, "
               "parent_process_name string, command_line_args string, event_code string, bytes_sent bigint")
    given = [("a", "C:\\notevil.exe", "p", None, "9.9.9.9", "X", 77, None, None, None, 0), ("b", None, f"..{bad.upper()}..", "9.9.9.9", "", "X", 0, None, None, None, 0),
             ("c", "fine", "p", "1.1.1.1", None, "X", 1, None, None, None, 0)]
    frame = spark.createDataFrame(given, columns)
    found = {r.log_uuid: r for r in severity.triage_score(threat_lists.with_list_hits(frame, lists), lists.config).collect()}
    weights = lists.config.scoring_weights
    assert found["a"].score == weights["dangerous_process"] + weights["c2_port"] + 7
    assert found["b"].score == weights["known_bad_hash"] + 7 and found["c"].score == 0
    defaults = threat_lists.from_table(spark.createDataFrame([], threat_lists.SCHEMA))
    assert defaults.config == dims.ThreatConfig() and defaults.ips.count() == len(dims.C2_IPS)


def test_long_lists_leave_the_plan_as_it_is(spark, rows, tmp_path):
    def plan(n_hashes, n_names):
        path = str(tmp_path / f"lists{n_hashes}")
        hashes = spark.range(n_hashes).select(F.lit("bad_hash").alias("kind"), F.lit(None).cast("string").alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("value"))
        names = spark.range(n_names).select(F.lit("dangerous_process").alias("kind"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("tool"), F.col("id").cast("string")).alias("value"))
        hashes.unionByName(names).coalesce(1).write.parquet(path)
        scored = severity.triage_score(threat_lists.with_list_hits(rows, threat_lists.load(spark, path)))
        return scored, len(scored._jdf.queryExecution().analyzed().toString())

    few, many = plan(3, 3), plan(100_000, 10_000)
    assert abs(few[1] - many[1]) < 2000
    assert many[0].filter("array_contains(heuristic_flags, 'known_bad_hash')").count() == 0


def test_automata_in_parts(spark):
    words = spark.createDataFrame([(w,) for w in ("alpha", "BETA", "gamma", "", "alphabet", "é")], "value string")
    frame = spark.createDataFrame([("xalphax",), ("beta",), ("gam",), (None,), ("",), ("cafÉ",)], "t string")
    for most in (6, 1000):
        found = threat_lists.with_substring_hit(frame, "t", words, "hit", most).collect()
        assert [r.hit for r in found] == [True, True, False, False, False, True]
    assert [r.hit for r in threat_lists.with_substring_hit(frame, "t", words.limit(0), "hit").collect()] == [False] * 6
