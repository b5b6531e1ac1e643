"""One query per operator over the given tables: name -> callable(spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions import detect, fields, text
from vigilark.operators import (activity, clusters, deadletters, enrich, graph, integrity,
                                normalize, parse, queueing, reports, retrieval, severity,
                                similarity, validate, vector_index)
from vigilark.plans import derive
from vigilark.plans.stages import canonical_rows, triaged_rows
from vigilark.session import configure, scratch_path
from vigilark.sources import archive, lines, threat_lists, vector_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY_S = 86_400
# The sample events are spread over a month, so the windows here are wide.
SCAN = {"window_s": 7 * DAY_S, "threshold": 8}
BURST = {"window_s": 7 * DAY_S, "threshold": 3}
SIMILARITY = 0.3
NOW = "2024-01-20 00:00:00"
INGESTED = "2024-02-01 00:00:00"


def query(name: str):
    def register(run: Query) -> Query:
        def configured(spark: SparkSession, folder: str) -> DataFrame:
            return run(configure(spark), folder)

        QUERIES[name] = configured
        return run

    return register


def stamp(value: str) -> Column:
    return F.lit(value).cast("timestamp")


def shown(name: str | Column) -> Column:
    """A timestamp as text with microseconds."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _parsed(spark, folder):
    return parse.parse_lines(derive.raw_lines(spark, folder))


def _normalized(spark, folder):
    return normalize.normalize(parse.identify_source(_parsed(spark, folder)),
                               ingested_at=stamp(INGESTED), keep=("event_id", "source_path"))


def _enriched(spark, folder):
    return enrich.enrich(derive.sec_log(spark, folder))


def _queued(spark, folder):
    return severity.queue_severity(_enriched(spark, folder))


def _triaged(spark, folder):
    return triaged_rows(_enriched(spark, folder), scan=SCAN)


# ---- sources and sinks -------------------------------------------------------------------

@query("scan_lines")
def scan_lines(spark, folder):
    path = scratch_path(spark, "lines")
    raw = derive.raw_lines(spark, folder)
    raw.select(F.element_at(F.split("source_path", r"\."), -1).alias("kind"), "line").write.partitionBy(
        "kind").text(path)
    return lines.scan_lines(spark, path).select(
        F.regexp_extract("source_path", "kind=([a-z]+)", 1).alias("kind"), "line")


@query("line_uuids")
def line_uuids(spark, folder):
    return normalize.assign_uuids(derive.repeated_lines(spark, folder)).select(
        "log_uuid", "source_path", "line")


@query("phase_label")
def phase_label(spark, folder):
    return lines.label_phases(derive.scenario_lines(spark, folder), block_lines=1000)


def _archived(spark, folder):
    path = scratch_path(spark, "archive")
    archive.append_archive(derive.sec_log(spark, folder).select(
        "log_uuid", "event_timestamp", "event_type", "hostname", "source_ip", "process_name",
        "raw_payload", "sha256_hash"), path)
    return archive.read_archive(spark, path)


@query("archive")
def archive_rows(spark, folder):
    return _archived(spark, folder).groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count("*").alias("n_rows"), F.min("log_uuid").alias("first_uuid"))


@query("archive_lookup")
def archive_lookup(spark, folder):
    found = archive.lookup(_archived(spark, folder), "2024-01-05 06:00:00", "2024-01-15 18:00:00",
                           process_name="cmd.exe")
    return found.select("log_uuid", shown("event_timestamp").alias("event_time"), "source_ip")


@query("archive_by_uuid")
def archive_by_uuid(spark, folder):
    wanted = derive.sec_log(spark, folder).filter(F.col("event_type") == "EXFILTRATION_HINT")
    return archive.lookup_uuids(_archived(spark, folder), wanted).select(
        "log_uuid", "hostname", "sha256_hash")


@query("dead_letters")
def dead_letter_append(spark, folder):
    bad = _normalized(spark, folder).filter("normalize_failed")
    letters = deadletters.dead_letters(
        bad, "INGESTION", F.lit("event_type is not text"), ["source_path", "raw_payload"],
        shown("ingestion_timestamp"), row_id="event_id")
    path = scratch_path(spark, "letters")
    deadletters.append_dead_letters(letters, path)
    return spark.read.parquet(path).select("work_type", "payload", "failure_reason", "failed_at",
                                           "retry_count", "resolved")


def _shown_vector(rows):
    """The vector as its length and sum."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumns({"dims": F.size("embedding"), "vector_sum": F.round(total, 4)}).drop("embedding")


@query("vector_upsert")
def vector_upsert(spark, folder):
    rows = derive.vectors(spark, folder)
    rewritten = rows.filter(F.col("label") < 5).withColumn(
        "more", F.explode(F.array(F.lit(10), F.lit(20)))).select(
        "id", F.concat(F.lit("new "), F.col("document")).alias("document"),
        (F.col("event_epoch") + F.col("more")).alias("event_epoch"), "event_type",
        F.transform("embedding", lambda x: x * F.col("more").cast("float")).alias("embedding"), "label")
    target = rows.filter(F.col("label") >= 2)
    return _shown_vector(vector_store.upsert(target, rewritten, ["event_epoch"]))


@query("vector_insert")
def vector_insert(spark, folder):
    rows = derive.vectors(spark, folder)
    batch = rows.withColumn("document", F.concat(F.lit("late "), F.col("document")))
    return _shown_vector(vector_store.insert_absent(rows.filter(F.col("label") >= 4), batch, ["event_epoch"]))


@query("vector_records")
def vector_records(spark, folder):
    rows = _enriched(spark, folder).withColumn("synthetic_intent", F.when(
        F.col("event_type") != "FILE_WRITE", F.col("synthetic_intent")).otherwise("  "))
    return vector_store.vector_records(rows).select(
        "id", "document", "event_epoch", "event_type", "hostname", "source_ip", "dest_ip")


@query("vector_record_counts")
def vector_record_counts(spark, folder):
    rows = _enriched(spark, folder).withColumn("synthetic_intent", F.when(
        F.col("event_type") != "FILE_WRITE", F.col("synthetic_intent")))
    return vector_store.record_counts(rows)


@query("graph_export")
def graph_export(spark, folder):
    rows = derive.sec_log(spark, folder)
    nodes = graph.build_nodes(graph.log_node_parts(rows))
    edges = graph.build_edges(graph.log_edge_parts(rows))
    return graph.export_elements(nodes, edges)


@query("inject_rows")
def inject_rows(spark, folder):
    asked = derive.sec_log(spark, folder).select(
        "log_uuid", F.when(F.col("event_id") % 11 == 0, "NOT_A_TYPE").otherwise(F.col("event_type"))
        .alias("event_type"),
        F.when(F.col("event_id") % 13 != 0, F.col("hostname")).alias("hostname"), "source_ip", "dest_ip",
        F.col("raw_payload").alias("raw_line"))
    return normalize.inject_rows(asked)


# ---- parse and identify ------------------------------------------------------------------

@query("parse_lines")
def parse_lines(spark, folder):
    return _parsed(spark, folder).select(
        "event_id", "format", F.coalesce(F.size("fields"), F.lit(0)).alias("n_fields"),
        F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("keys"),
        F.col("fields")["src"].alias("src"), F.col("fields")["id.orig_h"].alias("orig_h"),
        F.col("fields")["device"].alias("device"))


@query("identify_source")
def identify_source(spark, folder):
    return parse.identify_source(_parsed(spark, folder)).select(
        "event_id", "log_source",
        parse.source_from_path("source_path").alias("path_source"),
        parse.source_from_fields("fields").alias("field_source"))


@query("format_counts")
def format_counts(spark, folder):
    return parse.format_counts(_parsed(spark, folder))


@query("event_time")
def event_time(spark, folder):
    return _normalized(spark, folder).select(
        "event_id", "event_timestamp_raw",
        fields.iso_epoch(F.col("event_timestamp_raw")).alias("event_epoch"))


@query("custody_hash")
def custody_hash(spark, folder):
    return integrity.with_custody_hash(derive.raw_lines(spark, folder), "line").select(
        "event_id", "sha256_hash")


@query("event_code_join")
def event_code_join(spark, folder):
    coded = parse.identify_source(_parsed(spark, folder)).select(
        "event_id", "log_source",
        fields.safe_str(fields.pick("fields", "EventID", "event.code")).alias("event_code"))
    return normalize.event_types(coded.filter(F.col("event_code").isNotNull()))


@query("normalize")
def normalized(spark, folder):
    return _normalized(spark, folder).select(
        "event_id", "log_source", "event_timestamp_raw", "event_type", "hostname", "source_ip",
        "dest_ip", "source_port", "dest_port", "process_name", "parent_process_name",
        "user_account", "event_code", "file_path", "registry_key", "command_line_args",
        "dns_query", "http_url", "http_method", "bytes_sent", "bytes_received", "severity_hint",
        "sha256_hash", "normalize_failed")


@query("ingest_split")
def ingest_split(spark, folder):
    stored, bad = normalize.split_ingest(_normalized(spark, folder), "event_id")
    letters = bad.groupBy(F.col("failure_reason").alias("outcome")).agg(
        F.count("*").alias("n"), F.countDistinct("dlq_uuid").alias("n_ids"),
        F.sum(F.length("payload")).alias("n_chars"))
    return stored.groupBy(F.lit("stored").alias("outcome")).agg(
        F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"),
        F.sum(F.length("raw_payload")).alias("n_chars")).unionByName(letters)


@query("validate_rows")
def validate_rows(spark, folder):
    rows = derive.sec_log(spark, folder).select(
        "log_uuid", F.when(F.col("event_id") % 71 != 0, F.col("event_timestamp")).alias("event_timestamp"),
        F.when(F.col("event_id") % 73 == 0, "STRANGE").otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 79 != 0, F.col("hostname")).alias("hostname"),
        F.when(F.col("event_id") % 83 == 0, "short").otherwise(F.col("sha256_hash")).alias("sha256_hash"),
        "raw_payload", "source_port", "dest_port",
        F.when(F.col("event_id") % 41 == 0, "HIGH").otherwise(F.col("severity_hint")).alias("severity_hint"),
        (F.col("event_id") % 103 / 100).alias("confidence"))
    return validate.violations(rows)


@query("quarantine")
def quarantine(spark, folder):
    rows = derive.sec_log(spark, folder).withColumns({
        "event_type": F.when(F.col("event_id") % 73 == 0, "STRANGE").otherwise(F.col("event_type")),
        "hostname": F.when(F.col("event_id") % 79 != 0, F.col("hostname"))})
    return validate.quarantine(rows)[1].select(
        "log_uuid", F.array_join("broken_rules", ",").alias("broken_rules"))


# ---- enrichment --------------------------------------------------------------------------

@query("intent_text")
def intent_text(spark, folder):
    return _enriched(spark, folder).select("log_uuid", "synthetic_intent", "mitre_technique_hint")


@query("intent_text_ext")
def intent_text_ext(spark, folder):
    return enrich.enrich(derive.sec_log(spark, folder), opt_in=True).filter(
        F.col("event_type").isin("SERVICE_INSTALL", "SCHEDULED_TASK")).select(
        "log_uuid", "synthetic_intent", "mitre_technique_hint")


@query("technique_counts")
def technique_counts(spark, folder):
    return enrich.technique_counts(_enriched(spark, folder))


@query("dns_entropy")
def dns_entropy(spark, folder):
    hosts = derive.table(spark, folder, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("dns_query"))
    return hosts.select(
        "page_id", "dns_query", F.round(detect.shannon_entropy("dns_query"), 9).alias("entropy"),
        detect.label_count("dns_query").alias("n_labels"),
        detect.looks_tunnelled("dns_query").alias("suspicious"))


@query("private_ip_ranges")
def private_ip_ranges(spark, folder):
    return derive.sec_log(spark, folder).select(
        "log_uuid", "dest_ip", detect.is_private_ip("dest_ip").alias("dest_private"),
        detect.is_private_ip("source_ip").alias("source_private"))


@query("sqli_urls")
def sqli_urls(spark, folder):
    urls = derive.sec_log(spark, folder).select("log_uuid", F.col("http_url").alias("url")).unionByName(
        derive.table(spark, folder, "pages").select(
            F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("log_uuid"), "url"))
    return urls.filter(detect.has_sql_token("url"))


@query("system_dir_writes")
def system_dir_writes(spark, folder):
    return derive.sec_log(spark, folder).filter(
        (F.col("event_type") == "FILE_WRITE") & detect.in_system_dir("file_path")).select(
        "log_uuid", "hostname", "file_path")


@query("webshell_spawn")
def webshell_spawn(spark, folder):
    return derive.sec_log(spark, folder).filter(
        (F.col("event_type") == "PROCESS_CREATION") & detect.is_web_server("parent_process_name")
    ).select("log_uuid", "hostname", "parent_process_name", "process_name")


# ---- scoring -----------------------------------------------------------------------------

@query("queue_severity")
def queue_severity(spark, folder):
    return _queued(spark, folder).select("log_uuid", "severity", "priority")


def _score_columns(rows):
    return rows.select(
        "log_uuid", "score", "triage_severity", "correlation_required", "anomaly_detected",
        "confidence", F.array_join("heuristic_flags", "|").alias("flags"))


@query("triage_score")
def triage_score(spark, folder):
    return _score_columns(_triaged(spark, folder))


@query("triage_score_basic")
def triage_score_basic(spark, folder):
    deployed = dims.ThreatConfig().override(
        dangerous_processes=dims.DANGEROUS_PROCESSES + dims.EXTRA_DANGEROUS_PROCESSES)
    return _score_columns(triaged_rows(_enriched(spark, folder), deployed, profile="basic"))


@query("triage_score_weighted")
def triage_score_weighted(spark, folder):
    config = dims.ThreatConfig().override(
        c2_ports=[22, 3389], scoring_weights={"c2_port": 45, "shadow_delete": 5},
        severity_thresholds={"P1": 50})
    rows = threat_lists.with_list_hits(_enriched(spark, folder), threat_lists.of_config(spark, config))
    rows = severity.triage_score(rows, config)
    return rows.groupBy("triage_severity", "score").agg(F.count("*").alias("n_events"))


@query("triage_route")
def triage_route(spark, folder):
    return severity.with_route(triaged_rows(_enriched(spark, folder), with_activity=False)).select("route", "log_uuid")


@query("handoff_gate")
def handoff_gate(spark, folder):
    stage = derive.sec_log(spark, folder).select(
        "log_uuid", F.when(F.col("event_id") % 29 == 0, "timeline").otherwise("triage").alias("from_skill"),
        F.when(F.col("event_id") % 23 == 0, "0.9.0").otherwise(dims.SCHEMA_VERSION).alias("schema_version"))
    return severity.with_handoff_failure(stage, "triage").select(
        "log_uuid", F.coalesce("failure_reason", F.lit("accepted")).alias("outcome"))


@query("bad_hash_match")
def bad_hash_match(spark, folder):
    listed = dims.values_dim(spark, dims.BAD_HASHES, "hash string")
    return severity.bad_hash_matches(derive.sec_log(spark, folder), listed).select("log_uuid", "hash")


@query("large_transfer")
def large_transfer(spark, folder):
    return derive.sec_log(spark, folder).filter(
        F.col("bytes_sent") > dims.LARGE_TRANSFER_BYTES).select("log_uuid", "hostname", "bytes_sent")


@query("c2_ip_match")
def c2_ip_match(spark, folder):
    listed = dims.values_dim(spark, dims.C2_IPS, "ip string")
    return severity.c2_matches(derive.sec_log(spark, folder), listed).select(
        "log_uuid", "source_hit", "dest_hit")


@query("threat_semi")
def threat_semi(spark, folder):
    listed = dims.values_dim(spark, dims.C2_PORTS, "port int")
    return severity.threat_join(derive.sec_log(spark, folder), listed, "dest_port").select(
        "log_uuid", "dest_port")


@query("threat_anti")
def threat_anti(spark, folder):
    listed = dims.values_dim(spark, dims.C2_PORTS, "port int")
    return severity.threat_join(derive.sec_log(spark, folder), listed, "dest_port",
                                keep_matches=False).select("log_uuid", "dest_port")


@query("firewall_rules")
def firewall_rules(spark, folder):
    return severity.firewall_rules(derive.sec_log(spark, folder)).select(
        "log_uuid", "rule", "event_type", "mitre_technique_hint")


@query("severity_summary")
def severity_summary(spark, folder):
    """Raw lines through every stage to counts by type and severity."""
    rows = canonical_rows(derive.raw_lines(spark, folder), ingested_at=stamp(INGESTED),
                          keep=("event_id",))
    return severity.severity_summary(triaged_rows(rows, with_activity=False))


@query("outcome_totals")
def outcome_totals(spark, folder):
    """Ingested rows, dead letters and rows by severity in one pass of the lines."""
    rows = canonical_rows(derive.raw_lines(spark, folder), ingested_at=stamp(INGESTED), keep=("event_id",))
    return severity.outcome_totals(triaged_rows(rows, with_activity=False))


@query("p0_alerts")
def p0_alerts(spark, folder):
    return severity.p0_alerts(triaged_rows(_enriched(spark, folder), with_activity=False))


# ---- event-time activity -----------------------------------------------------------------

@query("ip_activity")
def ip_activity(spark, folder):
    return activity.ip_activity(derive.sec_log(spark, folder))


@query("ip_seen")
def ip_seen(spark, folder):
    return activity.ip_seen(derive.sec_log(spark, folder))


@query("port_scan")
def port_scan(spark, folder):
    return activity.port_scans(derive.sec_log(spark, folder), **SCAN)


@query("auth_burst")
def auth_burst(spark, folder):
    return activity.auth_bursts(derive.sec_log(spark, folder), **BURST).select(
        "log_uuid", "user_account", "hostname", "event_type", "failure_count")


@query("bruteforce_win")
def bruteforce_win(spark, folder):
    return activity.bruteforce_wins(derive.sec_log(spark, folder), **BURST, within_s=7 * DAY_S)


@query("dns_tunnel")
def dns_tunnel(spark, folder):
    rows = derive.sec_log(spark, folder).filter(F.col("event_type") == "DNS_QUERY")
    return activity.dns_tunnels(rows, window="10 days", min_queries=2).select(
        "source_ip", "parent", shown("window_start").alias("window_start"), "n_queries",
        F.round("avg_entropy", 9).alias("avg_entropy"))


@query("host_sessions")
def host_sessions(spark, folder):
    return activity.host_sessions(_queued(spark, folder), gap_s=3 * 3600).select(
        "hostname", "session_no", shown("session_start").alias("session_start"),
        shown("session_end").alias("session_end"), "n_events", "n_p0", "n_p1", "n_p2",
        "n_benign", "span_minutes")


# ---- queue -------------------------------------------------------------------------------

@query("next_items")
def next_items(spark, folder):
    return queueing.next_items(_queued(spark, folder), 100).select("log_uuid", "priority", "severity")


@query("shed_p2")
def shed_p2(spark, folder):
    return queueing.shed_load(_queued(spark, folder), drain="1 day", max_depth=20).filter(
        "dropped").select("log_uuid", shown("drain").alias("drain"), "severity")


@query("queue_stats")
def queue_stats(spark, folder):
    shed = queueing.shed_load(_queued(spark, folder), drain="1 day", max_depth=20)
    return queueing.queue_stats(shed, max_depth=20)


# ---- similarity --------------------------------------------------------------------------

@query("prepare_text")
def prepare_text(spark, folder):
    return retrieval.prepare_text(derive.table(spark, folder, "documents")).select(
        "doc_id", "truncated", "prepared")


@query("prepare_text_counts")
def prepare_text_counts(spark, folder):
    return retrieval.prepare_text(derive.table(spark, folder, "documents")).groupBy("lang").agg(
        F.count("*").alias("n_texts"), F.count_if("truncated").alias("n_truncated"),
        F.sum(F.length("prepared")).alias("n_chars"))


@query("embed_text")
def embed_text(spark, folder):
    vectors = retrieval.embed_text(_turns(spark, folder), "doc_id", dim=64)
    return vectors.select("doc_id", F.posexplode("embedding").alias("place", "weight")).filter(
        "weight > 0").withColumn("weight", F.round("weight", 6))


@query("embed_and_correlate")
def embed_and_correlate(spark, folder):
    """Texts to vectors to neighbours: the turns of ten conversations in a row are an hour."""
    turns = _turns(spark, folder)
    vectors = retrieval.embed_text(turns, "doc_id", dim=64)
    rows = turns.join(vectors, "doc_id").select(
        F.col("doc_id").alias("id"), "embedding", (F.col("conv_id") * 360 + F.col("turn")).cast("double").alias("event_epoch"),
        F.when(F.col("role") == "assistant", "FILE_WRITE").otherwise("DNS_QUERY").alias("event_type"))
    asking = rows.filter(F.col("event_type") == "FILE_WRITE")
    return similarity.correlate(asking, rows, k=5, threshold=0.5).select("trigger_id", "id", "similarity", "rank")


@query("temporal_candidates")
def temporal_candidates(spark, folder):
    rows = derive.vectors(spark, folder)
    return similarity.temporal_candidates(similarity.with_window(rows), rows)


def _correlated(spark, folder):
    rows = derive.vectors(spark, folder)
    return rows, similarity.correlate(rows, rows, threshold=SIMILARITY)


@query("correlate")
def correlate(spark, folder):
    return _correlated(spark, folder)[1].select("trigger_id", "id", "similarity", "rank")


@query("correlate_l2sq")
def correlate_l2sq(spark, folder):
    rows = derive.vectors(spark, folder)
    return similarity.correlate(rows, rows, threshold=2 * SIMILARITY - 1, metric="l2sq").select(
        "trigger_id", "id", "similarity")


@query("correlation_summary")
def correlation_summary(spark, folder):
    rows, hits = _correlated(spark, folder)
    return similarity.correlation_summary(rows, hits, rows).select(
        "trigger_id", "cluster_size", "temporal_span_minutes", "cold_start",
        F.array_join("correlated_uuids", ",").alias("uuids"))


@query("correlate_lsh")
def correlate_lsh(spark, folder):
    """Through the index table. It replaces hash tables, which lost links; the key stays."""
    rows = derive.vectors(spark, folder)
    index = vector_index.build(rows, scratch_path(spark, "vector-index"), cells=8)
    return vector_index.correlate_indexed(rows, rows, index, threshold=SIMILARITY).select(
        "trigger_id", "id", "similarity")


def _serious() -> Column:
    return F.col("event_type").isin(*dims.QUEUE_P0_TYPES, *dims.QUEUE_P1_TYPES)


def _similar(spark, folder):
    classes, members = similarity.copy_classes(derive.vectors(spark, folder), _serious())
    return similarity.similar_classes(classes, threshold=0.25), classes, members


@query("similar_pairs")
def similar_pairs(spark, folder):
    """Pairs of classes of copies, by their smallest ids, and the class of every row."""
    pairs, _, members = _similar(spark, folder)
    return similarity.pairs_and_members(pairs, members)


@query("similar_rows")
def similar_rows(spark, folder):
    """The single rows behind them."""
    return similarity.expanded(*_similar(spark, folder))


@query("attack_clusters")
def attack_clusters(spark, folder):
    return clusters.attack_clusters(*_similar(spark, folder))


@query("tier_split")
def tier_split(spark, folder):
    rows = derive.vectors(spark, folder)
    now = rows.agg(F.max("event_epoch").alias("m")).first().m
    stay, move = vector_store.split_tiers(rows, now, hot_s=2 * 3600)
    return _shown_vector(stay.select("id", "embedding", F.lit("active").alias("tier")).unionByName(
        move.select("id", "embedding", F.lit("archive").alias("tier"))))


@query("tier_stats")
def tier_stats(spark, folder):
    rows = derive.vectors(spark, folder).drop("embedding")
    now = rows.agg(F.max("event_epoch").alias("m")).first().m
    old = rows.filter(F.col("label") == 3)
    return vector_store.tier_stats(*vector_store.migrate(rows, old, now, hot_s=2 * 3600))


# ---- retrieval ---------------------------------------------------------------------------

@query("tfidf_search")
def tfidf_search(spark, folder):
    asked = derive.table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    return retrieval.tfidf_search(derive.table(spark, folder, "documents"), asked).select(
        "query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _turns(spark, folder):
    return derive.table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", F.lpad(F.col("turn").cast("string"), 6, "0")).alias("doc_id"),
        "conv_id", "turn", "role", "text")


def _retrieval(spark, folder):
    """The opening turn of a conversation asks for the other turns of the same conversation."""
    turns = _turns(spark, folder)
    opening = turns.filter(F.col("turn") == 0)
    ranked = retrieval.tfidf_search(turns, opening.select(F.col("doc_id").alias("query_id"), "text"))
    truth = opening.select("conv_id", F.col("doc_id").alias("query_id")).join(
        turns.filter(F.col("turn") != 0).select("conv_id", "doc_id"), "conv_id")
    return opening, retrieval.query_metrics(ranked, truth)


@query("retrieval_metrics")
def retrieval_metrics(spark, folder):
    return retrieval.mean_metrics(_retrieval(spark, folder)[1])


@query("retrieval_by_group")
def retrieval_by_group(spark, folder):
    opening, per_query = _retrieval(spark, folder)
    roles = opening.select(F.col("doc_id").alias("query_id"), "role")
    return retrieval.mean_metrics(per_query.join(roles, "query_id"), "role")


# ---- graph -------------------------------------------------------------------------------

def _log_graph(spark, folder):
    rows = derive.sec_log(spark, folder)
    return graph.log_node_parts(rows), graph.log_edge_parts(rows)


def _node_columns(nodes):
    return nodes.select(
        "id", "type", "label", "threat_score", "risk_level", "color", "shape", "touches",
        shown("first_seen").alias("first_seen"), shown("last_seen").alias("last_seen"))


def _edge_columns(edges):
    return edges.select("id", "source", "target", "type", "label", "mitre_technique_id",
                        shown("timestamp").alias("timestamp"))


@query("graph_nodes")
def graph_nodes(spark, folder):
    return _node_columns(graph.build_nodes(_log_graph(spark, folder)[0]))


@query("graph_edges")
def graph_edges(spark, folder):
    return _edge_columns(graph.build_edges(_log_graph(spark, folder)[1]))


@query("graph_report_edges")
def graph_report_edges(spark, folder):
    return _edge_columns(graph.build_edges(graph.report_edge_parts(derive.reports(spark, folder))))


def _full_parts(spark, folder):
    nodes, edges = _log_graph(spark, folder)
    told = derive.reports(spark, folder)
    return (nodes.unionByName(graph.report_node_parts(told)),
            edges.unionByName(graph.report_edge_parts(told)))


@query("graph_full")
def graph_full(spark, folder):
    nodes = graph.build_nodes(_full_parts(spark, folder)[0])
    return nodes.select("id", "type", "label", "threat_score", "risk_level")


@query("graph_stats")
def graph_stats(spark, folder):
    nodes, edges = _full_parts(spark, folder)
    return graph.stats(graph.build_nodes(nodes), graph.build_edges(edges))


@query("graph_delta")
def graph_delta(spark, folder):
    return graph.log_delta(derive.sec_log(spark, folder), F.col("event_timestamp") >= stamp(NOW))


# ---- reports -----------------------------------------------------------------------------

@query("evidence_bundle")
def evidence_bundle(spark, folder):
    rows, hits = _correlated(spark, folder)
    facts = rows.select(
        "id", F.date_format(F.timestamp_seconds("event_epoch"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        .alias("event_timestamp"), F.col("document").alias("synthetic_intent"),
        F.when(F.col("label") == 3, "T1071.004").alias("mitre_technique_hint"))
    return reports.evidence_bundles(
        rows.select("id", F.col("document").alias("synthetic_intent")), hits.join(facts, "id"))


@query("parse_reports")
def parse_reports(spark, folder):
    parsed = reports.parse_responses(derive.responses(spark, folder))
    return parsed.select(
        "trigger_id", "attempt", F.coalesce("problem", F.lit("")).alias("problem"),
        F.col("report.narrative").alias("narrative"), F.col("report.confidence").alias("confidence"),
        F.array_join("report.mitre_techniques", ",").alias("techniques"))


@query("fallback_report")
def fallback_report(spark, folder):
    told = derive.reports(spark, folder)
    triggers = told.select(
        F.col("report_id").alias("id"), F.col("narrative").alias("synthetic_intent"), "hostname",
        "user_account", "process_name", F.col("report_time").alias("event_timestamp"))
    valid = reports.first_valid(reports.parse_responses(derive.responses(spark, folder)))
    return reports.final_reports(triggers, valid).select(
        "trigger_id", "attempts", "is_fallback", F.col("report.narrative").alias("narrative"),
        F.col("report.confidence").alias("confidence"),
        F.array_join("report.mitre_techniques", ",").alias("techniques"),
        F.when(F.col("is_fallback"), F.col("report.report_id")).alias("fallback_id"))


@query("report_markdown")
def report_markdown(spark, folder):
    return derive.reports(spark, folder).select("report_id", reports.markdown().alias("body"))


@query("report_plaintext")
def report_plaintext(spark, folder):
    return derive.reports(spark, folder).select("report_id", reports.plaintext().alias("body"))


@query("mitre_names")
def mitre_names(spark, folder):
    named = reports.named_techniques(
        _enriched(spark, folder).filter(F.col("mitre_technique_hint").isNotNull()))
    return named.groupBy("mitre_technique_hint", "mitre_name").agg(F.count("*").alias("n_events"))


@query("chunk_messages")
def chunk_messages(spark, folder):
    messages = derive.table(spark, folder, "documents").select(
        "doc_id", F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    return reports.chunk_rows(messages, "text").select("doc_id", "chunk_no", "chunk")


@query("report_stats")
def report_stats(spark, folder):
    return reports.report_stats(derive.reports(spark, folder))


# ---- integrity and sanitising ------------------------------------------------------------

@query("tamper_audit")
def tamper_audit(spark, folder):
    stored = derive.sec_log(spark, folder).withColumn("raw_payload", F.when(
        F.col("event_id") % 89 == 0, F.concat("raw_payload", F.lit(" "))).otherwise(F.col("raw_payload")))
    return integrity.tamper_audit(stored).withColumn("event_date", F.col("event_date").cast("string"))


@query("sanitize_basic")
def sanitize_basic(spark, folder):
    return derive.injected_texts(spark, folder).select(
        "doc_id", text.sanitize_basic("text").alias("clean"))


@query("sanitize_strict")
def sanitize_strict(spark, folder):
    return derive.injected_texts(spark, folder).select(
        "doc_id", text.sanitize_strict("text").alias("clean"))


@query("sanitize_columns")
def sanitize_columns(spark, folder):
    rows = derive.sec_log(spark, folder).select(
        "log_uuid", "sha256_hash", F.concat(F.lit("user: "), F.col("user_account")).alias("note"),
        "raw_payload", "dest_port")
    return integrity.sanitize_columns(rows)


@query("injection_flags")
def injection_flags(spark, folder):
    return integrity.injection_flags(derive.injected_texts(spark, folder), "text", "source", "lang")


# ---- dead letters ------------------------------------------------------------------------

@query("dlq_eligible")
def dlq_eligible(spark, folder):
    return deadletters.eligible(derive.dead_letter_rows(spark, folder), stamp(NOW)).select(
        "dlq_uuid", "failed_at", "retry_count")


@query("dlq_retry")
def dlq_retry(spark, folder):
    _, after = deadletters.retry_pass(derive.dead_letter_rows(spark, folder), stamp(NOW))
    return after.select("dlq_uuid", "retry_count", "resolved")


@query("dlq_resubmit")
def dlq_resubmit(spark, folder):
    again, _ = deadletters.retry_pass(derive.dead_letter_rows(spark, folder), stamp(NOW))
    return again.select("log_uuid", "event_type", "hostname", "sha256_hash", "severity", "priority")


@query("dlq_escalate")
def dlq_escalate(spark, folder):
    return deadletters.escalations(derive.dead_letter_rows(spark, folder))


@query("dlq_summary")
def dlq_summary(spark, folder):
    return deadletters.summary(derive.dead_letter_rows(spark, folder))
