"""Report tables: evidence, response parsing, fallback, rendering and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.fields import map_lit, once
from vigilark.functions.text import chunk_message
from vigilark.operators.parse import strip
from vigilark.schema import REPORT

MAX_ATTEMPTS = 3

# ---- fixed values: wording ---------------------------------------------------------------
HEADERS = {"P0": "🔴 *P0 CRITICAL ALERT*", "P1": "🟠 *P1 HIGH ALERT*", "P2": "🟡 *P2 MEDIUM ALERT*"}
PLAIN_HEADERS = {"P0": "⚠️ P0 CRITICAL ALERT", "P1": "⚠️ P1 HIGH ALERT", "P2": "P2 MEDIUM ALERT"}
NO_NARRATIVE = "No narrative available."
TRIGGER = "TRIGGERING EVENT:\n"
CLUSTER = "\nCORRELATED EVENTS (ordered by similarity):"
COLD_START = "\nNO CORRELATED EVENTS (cold start — empty vector store)"
REQUEST = "\nGenerate the forensic report JSON now."
FALLBACK_TECHNIQUES = ["T1059", "T1021"]
FALLBACK_CONFIDENCE = 0.85


def evidence_bundles(triggers: DataFrame, hits: DataFrame) -> DataFrame:
    """(trigger_id, prompt): trigger text and its ranked neighbours as numbered lines.

    ``hits`` holds (trigger_id, rank, similarity, event_timestamp,
    synthetic_intent, mitre_technique_hint), at most k rows per trigger.
    """
    hint = F.when(F.length("mitre_technique_hint") > 0, F.concat(
        F.lit(" [MITRE hint: "), F.col("mitre_technique_hint"), F.lit("]"))).otherwise("")
    line = F.concat(
        F.lit("[similarity="),
        # format_number rounds the exact binary value, as the printed reports do.
        F.call_function("format_number", F.col("similarity"), F.lit("0.000")), F.lit("] ["),
        F.col("event_timestamp"), F.lit("] "), F.col("synthetic_intent"), hint)
    listed = hits.select("trigger_id", F.struct("rank", line.alias("line")).alias("r")).groupBy(
        "trigger_id").agg(F.sort_array(F.collect_list("r")).alias("ranked"))
    numbered = F.transform("ranked", lambda r, i: F.concat(
        F.lit("  "), (i + 1).cast("string"), F.lit(". "), r["line"]))
    intro = F.concat(F.lit(TRIGGER), F.coalesce("synthetic_intent", F.lit("Unknown event")))
    return (
        triggers.select(F.col("id").alias("trigger_id"), intro.alias("intro"))
        .join(listed, "trigger_id", "left")
        .select("trigger_id", F.concat_ws(
            "\n", F.col("intro"),
            F.when(F.size("ranked") > 0, F.array_join(
                F.concat(F.array(F.lit(CLUSTER)), numbered), "\n")).otherwise(COLD_START),
            F.lit(REQUEST)).alias("prompt"))
    )


def json_text(response: str | Column) -> Column:
    """The JSON part of a model response: the last fenced block with a narrative, else the last block."""
    text = strip(response)
    fence = F.when(text.contains("```json"), "```json").otherwise("```")
    pieces = F.split(text, fence)
    blocks = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))),
                         lambda b: strip(F.get(F.split(b, "```"), 0)))
    # The narrative test looks at the block before it is cut at the closing fence.
    raw_blocks = F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1)))
    useful = F.filter(F.arrays_zip(blocks.alias("block"), raw_blocks.alias("raw")),
                      lambda z: F.contains(F.lower(z["raw"]), F.lit('"narrative"')))
    return F.when(~text.contains("```"), text).otherwise(F.coalesce(
        F.get(F.reverse(useful), 0)["block"], F.get(F.reverse(blocks), 0)))


def parse_responses(responses: DataFrame, response: str = "response") -> DataFrame:
    """Add ``report`` (struct) and ``problem``; exactly one of them is set."""
    boxed = F.try_parse_json(F.concat(F.lit("["), F.col("_json"), F.lit("]")))
    kind = {name: F.schema_of_variant(F.variant_get("_variant", f"$.{name}", "variant"))
            for name in ("narrative", "confidence", "mitre_tactics", "mitre_techniques",
                         "entities", "timeline_events", "properties")}
    defs = F.variant_get("_variant", "$['$defs']", "variant").isNotNull()
    confidence = F.try_variant_get("_variant", "$.confidence", "double")
    bad_list = F.lit(False)
    for name in ("mitre_tactics", "mitre_techniques", "entities", "timeline_events"):
        bad_list = bad_list | F.coalesce(~kind[name].startswith("ARRAY"), F.lit(False))
    report = F.from_json("_json", REPORT)
    incomplete = F.coalesce(
        F.exists(report["entities"], lambda e: e["type"].isNull() | e["value"].isNull())
        | F.exists(report["timeline_events"],
                   lambda e: e["timestamp"].isNull() | e["description"].isNull()), F.lit(False))
    problem = (
        F.when(F.col("_variant").isNull(), "not one JSON object")
        .when(kind["properties"].isNotNull() | defs, "schema instead of data")
        .when(~F.coalesce(kind["narrative"] == "STRING", F.lit(False)), "narrative missing")
        .when(~F.coalesce(confidence.between(0.0, 1.0), F.lit(False)), "confidence outside 0 to 1")
        .when(bad_list | incomplete, "malformed list")
    )
    parsed = once(responses.withColumn("_json", json_text(response)), "_json")
    parsed = parsed.withColumn("_box", boxed).withColumn("_variant", F.when(
        F.col("_json").rlike(r"^\{[\s\S]*\}$")
        & F.variant_get("_box", "$[1]", "string").isNull(),
        F.variant_get("_box", "$[0]", "variant")))
    judged = once(parsed, "_variant").withColumn("problem", problem)
    return once(judged, "problem").withColumn(
        "report", F.when(F.col("problem").isNull(), report)).drop("_json", "_box", "_variant")


def first_valid(parsed: DataFrame) -> DataFrame:
    """(trigger_id, attempt, report): the first usable of at most three attempts."""
    usable = parsed.filter(F.col("problem").isNull() & (F.col("attempt") <= MAX_ATTEMPTS))
    return usable.groupBy("trigger_id").agg(
        F.min("attempt").alias("attempt"), F.min_by("report", "attempt").alias("report"))


def fallback_report(columns: list[str]) -> Column:
    """Report struct made of the trigger's own columns, used when no attempt was usable.

    The user is read from ``user``, not ``user_account``; without such a column it is SYSTEM.
    """
    intent = F.coalesce("synthetic_intent", F.lit("Suspicious activity detected"))
    host = F.coalesce("hostname", F.lit("UNKNOWN_HOST"))
    user = F.coalesce("user", F.lit("SYSTEM")) if "user" in columns else F.lit("SYSTEM")
    process = F.coalesce("process_name", F.lit("unknown"))
    when = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss")

    def entity(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit("").alias("role"))

    narrative = F.concat(
        F.lit("FALLBACK ANALYSIS: "), intent, F.lit(". This behavior on "), host,
        F.lit(" by user "), user,
        F.lit(" is consistent with known attack patterns. The autonomous analyst is operating "
              "in contingency mode due to high computational load."))
    event = F.struct(
        when.alias("timestamp"),
        F.concat(F.lit("Initial detection of "), intent, F.lit(" on "), host, F.lit("."))
        .alias("description"),
        F.lit("High").alias("severity"), F.lit("").alias("log_uuid"))
    none = F.array().cast("array<string>")
    return F.struct(
        narrative.alias("narrative"), F.lit(FALLBACK_CONFIDENCE).alias("confidence"),
        none.alias("mitre_tactics"),
        F.array(*[F.lit(t) for t in FALLBACK_TECHNIQUES]).alias("mitre_techniques"),
        F.array(entity("hostname", host), entity("user", user), entity("process", process))
        .alias("entities"),
        F.array(event).alias("timeline_events"), F.lit("").alias("root_cause"),
        F.concat(F.lit("RPT-FALLBACK-"), F.date_format("event_timestamp", "yyyyMMdd'T'HHmm'Z'"),
                 F.lit("-"), host).alias("report_id"))


def final_reports(triggers: DataFrame, valid: DataFrame) -> DataFrame:
    """One report per trigger: the first usable response or the fallback."""
    joined = triggers.join(valid.withColumnRenamed("trigger_id", "id"), "id", "left")
    made_up_id = F.sha2(F.concat(F.lit("report:"), F.col("id")), 256)
    chosen = F.col("report").withField("report_id", F.coalesce("report.report_id", made_up_id))
    return joined.select(
        F.col("id").alias("trigger_id"),
        F.coalesce("attempt", F.lit(MAX_ATTEMPTS)).alias("attempts"),
        F.col("report").isNull().alias("is_fallback"),
        F.when(F.col("report").isNotNull(), chosen).otherwise(fallback_report(triggers.columns)).alias("report"))


def _block(title: str | None, lines: Column, close: bool = True) -> Column:
    """Title, lines and a blank line, or nothing when there are no lines."""
    head = F.array(F.lit(title)) if title is not None else F.array().cast("array<string>")
    tail = F.array(F.lit("")) if close else F.array().cast("array<string>")
    return F.when(F.size(lines) > 0, F.concat(head, lines, tail)).otherwise(
        F.array().cast("array<string>"))


def _names(table: dict[str, str]):
    literal = map_lit(table)
    return lambda key: F.coalesce(literal[key], key)


def _header(table: dict[str, str]) -> Column:
    literal = map_lit(table)
    return F.coalesce(literal[F.col("severity")], F.lit(table["P1"]))


def _percent() -> Column:
    return F.round(F.coalesce("confidence", F.lit(0.0)) * 100, 1)


def _listed(column: str) -> Column:
    return F.coalesce(F.col(column), F.array())


def _optional(column: str) -> Column:
    return F.when(F.length(column) > 0, F.array(F.col(column))).otherwise(
        F.array().cast("array<string>"))


def _role(entity: Column) -> Column:
    return F.when(F.length(entity["role"]) > 0, F.concat(
        F.lit(" ("), entity["role"], F.lit(")"))).otherwise("")


def markdown(with_header: bool = True) -> Column:
    """Markdown text of a report row (narrative, confidence, lists, severity, report_id)."""
    text = F.lit
    events = F.transform(_listed("timeline_events"), lambda e: F.concat(
        text("  "), F.when(e["severity"] == "P0", "🔴").otherwise("🟡"), text(" `"),
        F.coalesce(e["timestamp"], text("??:??")), text("` — "),
        F.coalesce(e["description"], text(""))))
    entities = F.transform(_listed("entities"), lambda e: F.concat(
        text("  • "), F.coalesce(e["type"], text("unknown")), text(" "),
        F.when(e["type"].isin("ip", "process", "file"), F.concat(text("`"), e["value"], text("`")))
        .otherwise(F.coalesce(e["value"], text(""))), _role(e)))
    name = _names(dims.TACTICS)
    tactics = F.transform(_listed("mitre_tactics"), lambda t: F.concat(
        text("  • Tactic: `"), t, text("` — "), name(t)))
    techniques = _listed("mitre_techniques")
    joined = F.array_join(F.transform(techniques, lambda t: F.concat(text("`"), t, text("`"))), ", ")
    mitre = F.concat(tactics, F.when(
        F.size(techniques) > 0, F.array(F.concat(text("  • Techniques: "), joined))).otherwise(
        F.array().cast("array<string>")))
    filled = F.floor(_percent() / 10).cast("int")
    bar = F.concat(F.repeat(text("█"), filled), F.repeat(text("░"), 10 - filled))
    lines = [
        F.array(_header(HEADERS), text("")) if with_header else F.array().cast("array<string>"),
        F.array(text("📋 *Narrative*"), F.coalesce("narrative", text(NO_NARRATIVE)), text("")),
        _block("⏱ *Timeline*", events),
        _block("🎯 *Entities*", entities),
        _block("🛡 *MITRE ATT&CK*", mitre),
        _block("🔍 *Root Cause*", _optional("root_cause")),
        F.array(F.concat(text("📊 *Confidence:* "), _percent().cast("string"), text("% ["), bar,
                         text("]")), text("")),
        F.array(F.concat(text("🆔 Report: `"), F.coalesce("report_id", text("unknown")), text("`"))),
    ]
    return F.array_join(F.concat(*lines), "\n")


def plaintext() -> Column:
    """Plain text of a report row."""
    text = F.lit
    events = F.transform(_listed("timeline_events"), lambda e: F.concat(
        text("  ["), F.coalesce(e["timestamp"], text("??:??")), text("] "),
        F.coalesce(e["description"], text(""))))
    entities = F.transform(_listed("entities"), lambda e: F.concat(
        text("  ["), F.coalesce(e["type"], text("unknown")), text("] "),
        F.coalesce(e["value"], text("")), _role(e)))
    name = _names(dims.TACTICS)
    tactics = F.transform(_listed("mitre_tactics"), lambda t: F.concat(
        text("  Tactic: "), t, text(" - "), name(t)))
    techniques = _listed("mitre_techniques")
    mitre = F.concat(tactics, F.when(
        F.size(techniques) > 0,
        F.array(F.concat(text("  Techniques: "), F.array_join(techniques, ", ")))).otherwise(
        F.array().cast("array<string>")))
    cause = F.transform(_optional("root_cause"), lambda c: F.concat(text("ROOT CAUSE: "), c))
    lines = [
        F.array(_header(PLAIN_HEADERS), text("=" * 40), text("")),
        F.array(text("NARRATIVE:"), F.coalesce("narrative", text(NO_NARRATIVE)), text("")),
        _block("TIMELINE:", events),
        _block("ENTITIES:", entities),
        _block("MITRE ATT&CK:", mitre),
        _block(None, cause),
        F.array(F.concat(text("CONFIDENCE: "), _percent().cast("string"), text("%")), text("")),
        F.array(F.concat(text("Report ID: "), F.coalesce("report_id", text("unknown")))),
    ]
    return F.array_join(F.concat(*lines), "\n")


def chunk_rows(messages: DataFrame, message: str, max_chars: int = dims.MESSAGE_MAX_CHARS,
               reserve: int = 0) -> DataFrame:
    """One row per chunk of each message, numbered from 1."""
    rest = [c for c in messages.columns if c != message]
    return messages.select(
        *rest, F.posexplode(chunk_message(message, max_chars, reserve)).alias("pos", "chunk")
    ).withColumn("chunk_no", F.col("pos") + 1).drop("pos")


def named_techniques(rows: DataFrame, column: str = "mitre_technique_hint") -> DataFrame:
    """Add ``mitre_name``: the technique's, or its parent's, name from the reference table."""
    names = F.broadcast(dims.technique_dim(rows.sparkSession))
    return rows.withColumn("mitre_id", F.substring_index(column, ".", 1)).join(
        names, "mitre_id", "left")


def report_stats(reports: DataFrame) -> DataFrame:
    """Number of reports, mean confidence and distinct techniques, per severity.

    Techniques are reduced to one row per severity and technique first.
    """
    totals = reports.groupBy("severity").agg(
        F.count("*").alias("n_reports"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    techniques = (
        reports.select("severity", F.explode("mitre_techniques").alias("t")).distinct()
        .groupBy("severity").agg(F.count("*").alias("n_techniques"))
    )
    return totals.join(techniques, "severity", "left").withColumn(
        "n_techniques", F.coalesce("n_techniques", F.lit(0)))
