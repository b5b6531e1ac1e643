"""Headline queries at one scale; prints one JSON line with seconds per query."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigilark.plans.queries import QUERIES  # noqa: E402
from vigilark.session import START_SETTINGS, configure  # noqa: E402

HEADLINE = [
    "severity_summary", "parse_lines", "normalize", "intent_text", "triage_score", "ip_activity",
    "port_scan", "auth_burst", "bruteforce_win", "host_sessions", "shed_p2", "correlate",
    "similar_pairs", "attack_clusters", "tfidf_search", "graph_full", "graph_delta",
    "report_markdown", "sanitize_strict", "tamper_audit", "dlq_retry", "chunk_messages",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
    )
    for key, value in START_SETTINGS.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    # The trial tables are single files of one row group; large tables come in pieces by themselves.
    spark.conf.set("vigilark.input.pieces", cpus)
    names = sys.argv[1:] or HEADLINE
    QUERIES["large_transfer"](spark, folder).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
