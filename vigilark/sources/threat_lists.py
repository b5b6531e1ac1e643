"""Threat lists, weights, thresholds and windows from a table, of any length.

The table has rows (kind, name, value), from JSON lines or Parquet:

| kind | name | value |
|---|---|---|
| `dangerous_process`, `bad_hash`, `c2_ip`, `c2_port` | - | an entry of the list |
| `weight`, `threshold`, `window` | condition, severity, event type | a whole number |
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.dims import ThreatConfig

SCHEMA = "kind string, name string, value string"
#: Characters of one automaton, which every task holds; a longer list becomes several, of which a task holds one at a time.
AUTOMATON_CHARS = 4_000_000
#: Kinds whose rows are settings of the job, one for each condition, severity or event type.
SETTINGS = ("weight", "threshold", "window", "c2_port")


class ThreatLists(NamedTuple):
    """Long lists as frames (column ``value``), and the settings that fit in a plan."""

    config: ThreatConfig
    windows: dict[str, int]
    processes: DataFrame
    hashes: DataFrame
    ips: DataFrame


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> ThreatLists:
    """The lists below ``path``. A kind without any row keeps its default."""
    return from_table(spark.read.schema(SCHEMA).format(fmt).load(path))


def from_table(rows: DataFrame) -> ThreatLists:
    spark = rows.sparkSession
    present = {r.kind for r in rows.select("kind").distinct().collect()}
    # Settings are as many as there are conditions, severities, event types and ports.
    held = rows.filter(F.col("kind").isin(*SETTINGS)).collect()
    named = lambda kind: {r.name: int(r.value) for r in held if r.kind == kind}
    config = ThreatConfig().override(scoring_weights=named("weight"), severity_thresholds=named("threshold"))
    if "c2_port" in present:
        config = config.override(c2_ports=[int(r.value) for r in held if r.kind == "c2_port"])

    def listed(kind: str, default: tuple[str, ...]) -> DataFrame:
        if kind in present:
            return rows.filter(F.col("kind") == kind).select("value")
        return dims.values_dim(spark, default, "value string")

    return ThreatLists(config, dims.TEMPORAL_WINDOWS_S | named("window"), listed("dangerous_process", config.dangerous_processes),
                       listed("bad_hash", config.known_bad_hashes), listed("c2_ip", config.known_c2_ips))


def of_config(spark: SparkSession, config: ThreatConfig) -> ThreatLists:
    """The same for lists that are at hand."""
    return ThreatLists(config, dims.TEMPORAL_WINDOWS_S, *(dims.values_dim(spark, v, "value string") for v in (
        config.dangerous_processes, config.known_bad_hashes, config.known_c2_ips)))


def _automata(words: list[str], most: int) -> list:
    """Aho-Corasick automata of at most ``most`` characters each, or of one longer word."""
    import ahocorasick

    found, size = [], most
    for word in words:
        if size + len(word) > most:
            found.append(ahocorasick.Automaton())
            size = 0
        found[-1].add_word(word, True)
        size += len(word)
    for automaton in found:
        automaton.make_automaton()
    return found


def with_substring_hit(rows: DataFrame, text: str, words: DataFrame, name: str, most: int = AUTOMATON_CHARS) -> DataFrame:
    """Add ``name``: does the column ``text`` hold any of the words (lower case)? One pass of a text for all words.

    Only the column ``text`` goes to Python, each distinct value of a batch once.
    """
    spark = rows.sparkSession
    held = [r.value for r in words.select(F.lower("value").alias("value")).filter(F.length("value") > 0).distinct().orderBy("value").toLocalIterator()]
    hit = F.lit(False)
    for automaton in _automata(held, most):
        hit = hit | _holds(spark.sparkContext.broadcast(automaton))(F.coalesce(F.lower(text), F.lit("")))
    return rows.withColumn(name, hit)


def _holds(shared: Broadcast):
    def found(values: pd.Series) -> pd.Series:
        known = {v: next(shared.value.iter(v), None) is not None for v in values.unique()}
        return values.map(known).astype(bool)

    return F.pandas_udf(found, "boolean")


def with_list_hits(rows: DataFrame, lists: ThreatLists, row_id: str = "log_uuid") -> DataFrame:
    """Add ``listed_process``, ``listed_hash`` and ``listed_ip`` for :func:`severity.triage_score`.

    Names are looked for as substrings of the process name; hashes (64 digits) among the runs of the payload,
    and addresses at either end, by joins. The plan is the same for lists of any length.
    """
    from vigilark.operators.severity import bad_hash_matches

    rows = with_substring_hit(rows, "process_name", lists.processes, "listed_process")
    hashed = bad_hash_matches(rows, lists.hashes.withColumnRenamed("value", "hash")).select(row_id).distinct()
    rows = rows.join(hashed.withColumn("listed_hash", F.lit(True)), row_id, "left")
    ips = lists.ips.select("value").distinct()
    for end in ("source", "dest"):
        rows = rows.join(ips.select(F.col("value").alias(f"{end}_ip"), F.lit(True).alias(f"_{end}")), f"{end}_ip", "left")
    return rows.withColumns({
        "listed_hash": F.coalesce("listed_hash", F.lit(False)),
        "listed_ip": F.coalesce(F.col("_source"), F.col("_dest"), F.lit(False))}).drop("_source", "_dest")
