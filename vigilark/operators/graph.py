"""The entity graph: nodes and edges from log rows and reports, deltas, statistics, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.fields import map_lit

NO_HOST = "unknown_host"
NO_VALUE = "unknown"


def node_id(kind: str | Column, value: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.lower(F.replace(F.concat(kind, F.lit(":"), value), F.lit(" "), F.lit("_")))


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat(F.lit("e_"), source, F.lit("_"), target, F.lit("_"), kind)


# ---- fixed values: which log columns become nodes and edges ------------------------------
LOG_ENTITIES = [("hostname", "hostname", NO_HOST), ("ip", "source_ip", NO_VALUE),
                ("ip", "dest_ip", NO_VALUE), ("process", "process_name", NO_VALUE),
                ("user", "user_account", NO_VALUE)]
LOG_EDGES = [(("hostname", "hostname"), ("ip", "source_ip"), "has_interface"),
             (("process", "process_name"), ("hostname", "hostname"), "executed_on"),
             (("user", "user_account"), ("process", "process_name"), "launched"),
             (("ip", "source_ip"), ("ip", "dest_ip"), "network_connection")]


def _given(column: str) -> Column:
    return F.coalesce(F.length(column) > 0, F.lit(False))


def _log_nodes() -> Column:
    """The node contributions of a row, as an array."""
    parts = []
    for kind, column, placeholder in LOG_ENTITIES:
        ends = [_given(a[1]) & _given(b[1]) for a, b, _ in LOG_EDGES
                for end in (a, b) if end[1] == column]
        n_ends = sum((F.when(e, 1).otherwise(0) for e in ends), F.lit(0))
        counted = _given(column) & (F.col(column) != placeholder)
        parts.append(F.when(counted | (_given(column) & (n_ends > 0)), F.struct(
            node_id(kind, F.col(column)).alias("id"), F.lit(kind).alias("type"),
            F.col(column).alias("label"),
            F.when(counted, dims.RAW_LOG_SCORE).otherwise(0.0).alias("score"),
            (F.when(counted, 1).otherwise(0) + n_ends).cast("bigint").alias("touches"))))
    return F.array_compact(F.array(*parts))


def log_node_parts(rows: DataFrame) -> DataFrame:
    """One contribution per entity of a row: +5 unless it is a placeholder, and its touches.

    A placeholder still becomes a node (with nothing added) when it ends an edge.
    """
    return rows.select(F.col("event_timestamp").alias("seen_at"), F.col("log_uuid").alias("origin"), F.inline(_log_nodes()))


def _log_edges() -> Column:
    """The edges of a row, as an array."""
    parts = []
    for (a_kind, a), (b_kind, b), kind in LOG_EDGES:
        source, target = node_id(a_kind, F.col(a)), node_id(b_kind, F.col(b))
        parts.append(F.when(_given(a) & _given(b), F.struct(
            edge_id(source, target, F.lit(kind)).alias("id"), source.alias("source"),
            target.alias("target"), F.lit(kind).alias("type"),
            F.lit("").alias("mitre_technique_id"))))
    return F.array_compact(F.array(*parts))


def log_edge_parts(rows: DataFrame) -> DataFrame:
    """Up to four edges per row."""
    return rows.select(F.col("event_timestamp").alias("seen_at"), F.col("log_uuid").alias("origin"), F.inline(_log_edges()))


def infer_edge_type(a: Column, b: Column) -> Column:
    def either(kind: str) -> Column:
        return (a == kind) | (b == kind)

    return (
        F.when((a == "ip") & (b == "ip"), "network_connection").when(either("process"), "process_spawn")
        .when(either("file"), "file_write").when(either("user"), "authentication")
        .otherwise("interaction")
    )


def _report_entities(reports: DataFrame) -> DataFrame:
    score = F.lit(dims.DEFAULT_REPORT_SCORE)
    for severity, value in dims.REPORT_SCORES.items():
        score = F.when(F.col("severity") == severity, value).otherwise(score)
    named = F.transform(
        F.filter("entities", lambda e: F.length(e["value"]) > 0),
        lambda e: F.struct(node_id(F.coalesce(e["type"], F.lit("unknown")), e["value"]).alias("id"),
                           F.coalesce(e["type"], F.lit("unknown")).alias("type"),
                           e["value"].alias("label")))
    return reports.select(
        F.col("report_time").alias("seen_at"), F.col("report_id").alias("origin"),
        score.alias("score"), F.coalesce(F.get("mitre_techniques", 0), F.lit("")).alias("technique"),
        named.alias("named"))


def report_node_parts(reports: DataFrame) -> DataFrame:
    """Contributions of report entities; each is touched once itself and once per edge it ends."""
    listed = _report_entities(reports)
    return listed.select("seen_at", "origin", "score",
                         F.size("named").cast("bigint").alias("touches"), F.inline("named")).select(
        "seen_at", "origin", "id", "type", "label", "score", "touches")


def report_edge_parts(reports: DataFrame) -> DataFrame:
    """Edges between the entities of a report, in list order.

    The pairs of one report are its own list, so they are formed inside the
    row from its distinct nodes: u comes before v when u's first place is
    before v's last.
    """
    listed = _report_entities(reports)
    placed = listed.select(
        "seen_at", "origin", "technique", "named",
        F.transform("named", lambda n: n["id"]).alias("ids"))
    first = F.filter(
        F.transform("named", lambda n, i: F.struct(
            n["id"].alias("id"), n["type"].alias("type"), (i + 1).alias("first"),
            (F.size("ids") - F.array_position(F.reverse("ids"), n["id"]) + 1).alias("last"))),
        lambda n: F.array_position("ids", n["id"]) == n["first"])
    pairs = placed.withColumn("nodes", first).withColumn("u", F.explode("nodes")).withColumn(
        "v", F.explode(F.filter("nodes", lambda n: n["last"] > F.col("u")["first"])))
    kind = infer_edge_type(F.col("u.type"), F.col("v.type"))
    return pairs.select(
        "seen_at", "origin", edge_id(F.col("u.id"), F.col("v.id"), kind).alias("id"),
        F.col("u.id").alias("source"), F.col("v.id").alias("target"), kind.alias("type"),
        F.col("technique").alias("mitre_technique_id"))


def risk_level(score: Column) -> Column:
    return F.when(score > 60, "high").when(score >= 30, "medium").otherwise("low")


def _map(table: dict[str, str], key: Column, default: str) -> Column:
    literal = map_lit(table)
    return F.coalesce(literal[key], F.lit(default))


def build_nodes(parts: DataFrame) -> DataFrame:
    """One row per node. Additions are never negative, so one capped sum equals capping each step."""
    first = F.struct("seen_at", "origin")
    nodes = parts.groupBy("id").agg(
        F.min_by("type", first).alias("type"), F.min_by("label", first).alias("label"),
        F.least(F.lit(100.0), F.sum("score")).alias("threat_score"),
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"),
        F.sum("touches").alias("touches"))
    return dress_nodes(nodes)


def dress_nodes(nodes: DataFrame) -> DataFrame:
    score = F.round("threat_score", 1)
    level = risk_level(F.col("threat_score"))
    return nodes.withColumns({
        "threat_score": score, "risk_level": level, "color": _map(dims.NODE_COLORS, level, ""),
        "shape": _map(dims.NODE_SHAPES, F.col("type"), "ellipse")})


def build_edges(parts: DataFrame) -> DataFrame:
    """One row per edge id with the first writer's attributes."""
    kept = F.struct("source", "target", "type", "mitre_technique_id",
                    F.col("seen_at").alias("timestamp"))
    edges = parts.groupBy("id").agg(F.min_by(kept, F.struct("seen_at", "origin")).alias("e"))
    return dress_edges(edges.select("id", "e.*"))


def dress_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns({
        "cosine_similarity": F.lit(0.0),
        "label": F.when(F.length("mitre_technique_id") > 0, F.col("mitre_technique_id"))
        .otherwise(F.col("type"))})


def merge_nodes(old: DataFrame, parts: DataFrame) -> DataFrame:
    """The node table after more contributions."""
    carried = old.select(
        F.col("first_seen").alias("seen_at"), F.lit("").alias("origin"), "id", "type", "label",
        F.col("threat_score").alias("score"), "touches", F.col("last_seen").alias("until"))
    fresh = parts.select("seen_at", "origin", "id", "type", "label", "score", "touches",
                         F.col("seen_at").alias("until"))
    first = F.struct("seen_at", "origin")
    nodes = carried.unionByName(fresh).groupBy("id").agg(
        F.min_by("type", first).alias("type"), F.min_by("label", first).alias("label"),
        F.least(F.lit(100.0), F.sum("score")).alias("threat_score"),
        F.min("seen_at").alias("first_seen"), F.max("until").alias("last_seen"),
        F.sum("touches").alias("touches"))
    return dress_nodes(nodes)


def merge_edges(old: DataFrame, parts: DataFrame) -> DataFrame:
    """The edge table after more contributions; existing edges stay as they are."""
    fresh = build_edges(parts.join(old.select("id"), "id", "left_anti"))
    return old.unionByName(fresh)


def delta(old_nodes: DataFrame, old_edges: DataFrame, node_parts: DataFrame,
          edge_parts: DataFrame) -> DataFrame:
    """(kind, id) changes of a batch: new nodes, updated nodes, new edges.

    A node is updated when it was there before or when the batch touches it
    again after creating it; so it can be both new and updated.
    """
    touched = node_parts.groupBy("id").agg(F.sum("touches").alias("n"))
    known = old_nodes.select("id", F.lit(True).alias("known"))
    state = touched.join(known, "id", "left").select(
        "id", "n", F.coalesce("known", F.lit(False)).alias("known"))
    new_edges = edge_parts.select("id").distinct().join(old_edges.select("id"), "id", "left_anti")
    return (
        state.filter(~F.col("known")).select(F.lit("new_node").alias("kind"), "id")
        .unionByName(state.filter(F.col("known") | (F.col("n") > 1))
                     .select(F.lit("updated_node").alias("kind"), "id"))
        .unionByName(new_edges.select(F.lit("new_edge").alias("kind"), "id"))
    )


def log_delta(rows: DataFrame, is_new: Column) -> DataFrame:
    """:func:`delta` of the rows that are new against the others, in one pass of both.

    A contribution carries which side it is of; one aggregate by id says what was there and what has come.
    """
    def marked(kind: str, parts: Column, touches) -> Column:
        return F.transform(parts, lambda x: F.struct(F.lit(kind).alias("part"), x["id"].alias("id"), touches(x).alias("touches")))

    both = F.concat(marked("node", _log_nodes(), lambda x: x["touches"]), marked("edge", _log_edges(), lambda x: F.lit(0).cast("bigint")))
    sides = rows.select(is_new.alias("new"), F.inline(both)).groupBy("part", "id").agg(
        F.max("new").alias("fresh"), F.min("new").alias("only_fresh"), F.sum(F.when(F.col("new"), F.col("touches"))).alias("n"))
    node, known = F.col("part") == "node", ~F.col("only_fresh")
    kinds = F.array_compact(F.array(
        F.when(node & ~known, "new_node"), F.when(node & (known | (F.col("n") > 1)), "updated_node"), F.when(~node & ~known, "new_edge")))
    return sides.filter("fresh").select(F.explode(kinds).alias("kind"), "id")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals, highest score, users, high-risk nodes: two one-row aggregates side by side."""
    left = nodes.agg(
        F.count("*").alias("total_nodes"), F.max("threat_score").alias("max_threat_score"),
        F.count_if(F.col("type") == "user").alias("n_users"),
        F.count_if(F.col("threat_score") > 60).alias("n_high_risk")).withColumn("k", F.lit(1))
    right = edges.agg(F.count("*").alias("total_edges")).withColumn("k", F.lit(1))
    return left.join(right, "k").drop("k")


def export_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(element, json): one ``{"data": ...}`` object per node and edge, for writing as JSON lines."""
    def iso(name: str) -> Column:
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias(name)

    node = F.struct("id", "label", "type", "threat_score", "risk_level", "color", "shape",
                    iso("first_seen"), iso("last_seen"))
    edge = F.struct("id", "source", "target", "type", "label", "cosine_similarity",
                    "mitre_technique_id", iso("timestamp"))
    return (
        nodes.select(F.lit("node").alias("element"),
                     F.to_json(F.struct(node.alias("data"))).alias("json"))
        .unionByName(edges.select(F.lit("edge").alias("element"),
                                  F.to_json(F.struct(edge.alias("data"))).alias("json")))
    )
