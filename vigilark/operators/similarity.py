"""Time-bounded nearest-neighbour search over the vector table.

Vectors meet in time buckets. A bucket is cut into chunks of at most about
``CHUNK_ROWS`` rows on each side and every pair of chunks is one task's
matrix product, so neither a busy hour nor a flood of copies lands in one
place. A task hands on only the ``k`` best rows per trigger, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.functions.timeblocks import running_sum

CHUNK_ROWS = 2000
BUCKET_S = 3600
RANK_DIGITS = 9
PAIR_SCHEMA = "trigger_id string, id string, similarity double"


def with_window(triggers: DataFrame, windows: DataFrame | None = None,
                default_s: int = dims.DEFAULT_TEMPORAL_WINDOW_S) -> DataFrame:
    """Add ``window_s`` by event type; the dimension is a dozen rows."""
    if windows is None:
        windows = dims.temporal_window_dim(triggers.sparkSession)
    return triggers.join(F.broadcast(windows), "event_type", "left").withColumn(
        "window_s", F.coalesce("window_s", F.lit(default_s)))


def _bucketed(triggers: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates in their own hour, triggers in every hour their window touches."""
    left = triggers.select(
        F.col("id").alias("trigger_id"), "event_epoch", "window_s", "embedding",
        F.explode(F.sequence(
            F.floor((F.col("event_epoch") - F.col("window_s")) / BUCKET_S),
            F.floor((F.col("event_epoch") + F.col("window_s")) / BUCKET_S))).alias("bucket"))
    # Fresh aliases: triggers and candidates often come from the same table.
    right = candidates.select(
        F.col("id").alias("id"), F.col("event_epoch").alias("event_epoch"),
        F.col("embedding").alias("embedding"),
        F.floor(F.col("event_epoch") / BUCKET_S).alias("bucket"))
    return left, right


def temporal_candidates(triggers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(trigger_id, n_candidates): rows within the trigger's window, both ends included.

    The count is the difference of two running totals over time, read off at
    the window's ends, so no pair is ever formed.
    """
    tick = F.floor(F.col("event_epoch") * 1_000_000).cast("bigint")
    width = F.col("window_s").cast("bigint") * 1_000_000
    marks = candidates.groupBy(tick.alias("at")).agg(F.count("*").alias("n")).select(
        "at", "n", F.lit(0).alias("sign"), F.lit("").alias("trigger_id"))
    edges = triggers.select(F.col("id").alias("trigger_id"), F.inline(F.array(
        F.struct((tick - width - 1).alias("at"), F.lit(-1).alias("sign")),
        F.struct((tick + width).alias("at"), F.lit(1).alias("sign")))))
    both = marks.unionByName(edges.withColumn("n", F.lit(0).cast("bigint")))
    # At equal times the stored rows (empty trigger id) sort before the edges.
    totals = running_sum(both, [], ["at", "trigger_id", "sign"], F.col("n"), "total")
    return totals.filter(F.col("sign") != 0).groupBy("trigger_id").agg(
        F.sum(F.col("sign") * F.col("total")).alias("n_candidates"))


def _matrix(table: pa.Table, metric: str) -> np.ndarray:
    column = table.column("embedding").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(table.num_rows, -1)
    if metric == "cosine":
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(norms == 0, 1.0, norms)
    return matrix


def _best_in_chunk(k: int, floor: float, metric: str):
    """The cogroup function: the ``k`` best candidates per trigger inside one chunk pair."""
    def search(triggers: pa.Table, candidates: pa.Table) -> pa.Table:
        out = {"trigger_id": [], "id": [], "similarity": []}
        if triggers.num_rows and candidates.num_rows:
            candidates = candidates.sort_by("id")
            ids = candidates.column("id").to_numpy()
            seconds = candidates.column("event_epoch").to_numpy()
            right = _matrix(candidates, metric)
            left = _matrix(triggers, metric)
            names = triggers.column("trigger_id").to_numpy()
            centre = triggers.column("event_epoch").to_numpy()
            width = triggers.column("window_s").to_numpy()
            for start in range(0, len(names), 256):
                part = slice(start, start + 256)
                scores = left[part] @ right.T
                if metric == "l2sq":
                    scores = 1.0 - ((left[part] ** 2).sum(axis=1)[:, None]
                                    + (right ** 2).sum(axis=1)[None, :] - 2.0 * scores)
                scores = np.round(scores, RANK_DIGITS)
                late = np.abs(seconds[None, :] - centre[part][:, None]) > width[part][:, None]
                scores[late] = -np.inf
                # Rows are in id order, so a stable sort breaks ties by id.
                if k is None:
                    rows, cols = np.nonzero(scores >= floor)
                    out["trigger_id"].append(names[part][rows])
                    out["id"].append(ids[cols])
                    out["similarity"].append(scores[rows, cols])
                    continue
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                kept = np.take_along_axis(scores, best, axis=1)
                rows, cols = np.nonzero(kept >= floor)
                out["trigger_id"].append(names[part][rows])
                out["id"].append(ids[best[rows, cols]])
                out["similarity"].append(kept[rows, cols])
        joined = {name: np.concatenate(parts) if parts else np.array([])
                  for name, parts in out.items()}
        return pa.table({
            "trigger_id": pa.array(joined["trigger_id"].astype(object), pa.string()),
            "id": pa.array(joined["id"].astype(object), pa.string()),
            "similarity": pa.array(joined["similarity"].astype(float), pa.float64())})

    return search


def by_chunks(left: DataFrame, right: DataFrame, keys: list[str], search, schema: str, chunk_rows: int) -> DataFrame:
    """``search`` over every pair of a chunk of ``left`` and a chunk of ``right`` with the same ``keys``."""
    def chunks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(
            F.ceil(F.count("*") / chunk_rows).cast("int").alias(name))

    plan = chunks(left, "left_chunks").join(chunks(right, "right_chunks"), keys)

    def spread(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.col(f"{own}_chunks")).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(f"{other}_chunks") - 1))
        return side.join(plan, keys).select(
            *side.columns, mine.alias(f"{own}_chunk"), copies.alias(f"{other}_chunk"))

    group = [*keys, "left_chunk", "right_chunk"]
    return (
        spread(left, "trigger_id", "left", "right").groupBy(*group)
        .cogroup(spread(right, "id", "right", "left").groupBy(*group))
        .applyInArrow(search, schema)
    )


def _chunked_best(left: DataFrame, right: DataFrame, keys: list[str], k: int | None, floor: float,
                  metric: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Best rows per trigger among candidates with the same ``keys``."""
    return by_chunks(left, right, keys, _best_in_chunk(k, floor, metric), PAIR_SCHEMA, chunk_rows)


def _rank(pairs: DataFrame, k: int) -> DataFrame:
    by_trigger = Window.partitionBy("trigger_id").orderBy(F.desc("similarity"), "id")
    return pairs.withColumn("rank", F.row_number().over(by_trigger)).filter(F.col("rank") <= k)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each trigger, without the trigger itself, similarity as shown."""
    return _rank(pairs, k).filter(F.col("trigger_id") != F.col("id")).withColumn("similarity", F.round("similarity", 4))


def correlate(triggers: DataFrame, candidates: DataFrame, k: int = dims.K_NEIGHBORS,
              threshold: float = dims.SIMILARITY_THRESHOLD, metric: str = "cosine",
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(trigger_id, id, similarity, rank): the ``k`` nearest rows in the window above a threshold.

    A trigger that is stored itself uses up one of the ``k`` places before it
    is removed. ``metric="l2sq"`` is one minus the squared distance.
    """
    left, right = _bucketed(with_window(triggers) if "window_s" not in triggers.columns
                            else triggers, candidates)
    pairs = _chunked_best(left, right, ["bucket"], k, threshold, metric, chunk_rows)
    return ranked(pairs, k)


def correlation_summary(triggers: DataFrame, hits: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per trigger: ranked ids and scores, size, span in minutes; empty ones are a cold start."""
    timed = hits.join(candidates.select("id", "event_epoch"), "id")
    positive = F.when(F.col("event_epoch") > 0, F.col("event_epoch"))
    span = F.when(F.count(positive) >= 2,
                  F.round((F.max(positive) - F.min(positive)) / 60, 2)).otherwise(0.0)
    # At most k rows per trigger, so the lists are bounded.
    grouped = timed.groupBy("trigger_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "similarity"))).alias("ranked"),
        F.count("*").alias("cluster_size"), span.alias("temporal_span_minutes"))
    return (
        triggers.select(F.col("id").alias("trigger_id")).join(grouped, "trigger_id", "left")
        .select(
            "trigger_id",
            F.coalesce("ranked.id", F.array().cast("array<string>")).alias("correlated_uuids"),
            F.coalesce("ranked.similarity", F.array().cast("array<double>")).alias("cosine_scores"),
            F.coalesce("cluster_size", F.lit(0)).alias("cluster_size"),
            F.coalesce("temporal_span_minutes", F.lit(0.0)).alias("temporal_span_minutes"),
            F.col("cluster_size").isNull().alias("cold_start"))
    )


def copy_classes(vectors: DataFrame, serious: Column) -> tuple[DataFrame, DataFrame]:
    """(classes, members): rows with one embedding, in one time slot and of one trigger window, are one class.

    A class is known by its smallest id and has its first and last time; ``window_s`` is null unless its rows are
    serious. Slots are no longer than the shortest window, so copies of a serious row that share a slot are in
    each other's window.
    """
    timed = with_window(vectors).withColumn("window_s", F.when(serious, F.col("window_s")))
    shortest = timed.agg(F.min("window_s")).first()[0]
    slot_s = float(max(1, min(shortest or BUCKET_S, BUCKET_S)))
    placed = timed.withColumn("bucket", F.floor(F.col("event_epoch") / slot_s))
    keys = ["embedding", "bucket", F.coalesce("window_s", F.lit(-1)).alias("reach_s")]
    classes = placed.groupBy(*keys).agg(
        F.min("id").alias("class_id"), F.min("event_epoch").alias("first"), F.max("event_epoch").alias("last"), F.count("*").alias("n")
    ).withColumn("slot_s", F.lit(slot_s))
    # The classes are computed once for both frames; their rows are joined back by what makes a class.
    members = placed.select("id", "event_epoch", *keys).join(
        classes.select("embedding", "bucket", "reach_s", "class_id"), ["embedding", "bucket", "reach_s"])
    window = F.when(F.col("reach_s") >= 0, F.col("reach_s")).alias("window_s")
    return classes.withColumn("window_s", window).drop("reach_s"), members.select("id", "event_epoch", "class_id", window)


CLASS_PAIRS = "trigger_id string, id string, similarity double, whole boolean"


def _linked_classes(floor: float, metric: str):
    """The cogroup function: pairs of classes above a threshold that have rows in each other's window."""
    def search(triggers: pa.Table, others: pa.Table) -> pa.Table:
        parts = []
        if triggers.num_rows and others.num_rows:
            left, right = _matrix(triggers, metric), _matrix(others, metric)
            names, ids = triggers.column("trigger_id").to_numpy(), others.column("id").to_numpy()
            a1, a2, width = (triggers.column(c).to_numpy()[:, None] for c in ("first", "last", "window_s"))
            b1, b2, n = (others.column(c).to_numpy()[None, :] for c in ("first", "last", "n"))
            for start in range(0, len(names), 256):
                part = slice(start, start + 256)
                scores = left[part] @ right.T
                if metric == "l2sq":
                    scores = 1.0 - ((left[part] ** 2).sum(axis=1)[:, None] + (right ** 2).sum(axis=1)[None, :] - 2.0 * scores)
                scores = np.round(scores, RANK_DIGITS)
                near = np.maximum(b1 - a2[part], a1[part] - b2) <= width[part]
                # A class is linked with itself if it has two rows.
                real = (names[part][:, None] != ids[None, :]) | (n > 1)
                row, col = np.nonzero((scores >= floor) & near & real)
                whole = np.maximum(b2 - a1[part], a2[part] - b1) <= width[part]
                parts.append((names[part][row], ids[col], scores[row, col], whole[row, col]))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.array([])] * 4
        return pa.table({"trigger_id": pa.array(columns[0].astype(object), pa.string()), "id": pa.array(columns[1].astype(object), pa.string()),
                         "similarity": pa.array(columns[2].astype(float), pa.float64()), "whole": pa.array(columns[3].astype(bool), pa.bool_())})

    return search


def similar_classes(classes: DataFrame, threshold: float = dims.SIMILARITY_THRESHOLD, metric: str = "cosine",
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(trigger_id, id, similarity, whole): the pairs of classes with linked rows, by their smallest ids.

    A serious row of the first class is linked with a row of the second if that is in its window, for all
    rows if ``whole``; so pairs and members say every link, and n copies of a row cost no n * n rows.
    """
    slots = F.sequence(F.floor((F.col("first") - F.col("window_s")) / F.col("slot_s")),
                       F.floor((F.col("last") + F.col("window_s")) / F.col("slot_s")))
    left = classes.filter("window_s is not null").select(
        F.col("class_id").alias("trigger_id"), "first", "last", "window_s", "embedding", F.explode(slots).alias("bucket"))
    # Fresh names: both sides come from the same table.
    right = classes.select(F.col("class_id").alias("id"), *(F.col(c).alias(c) for c in ("first", "last", "n", "embedding", "bucket")))
    pairs = by_chunks(left, right, ["bucket"], _linked_classes(threshold, metric), CLASS_PAIRS, chunk_rows)
    return pairs.withColumn("similarity", F.round("similarity", 4))


def pairs_and_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, trigger_id, id, similarity, whole, event_epoch, window_s): every link, without a row for each.

    A ``pair`` is one of classes, by their smallest ids. A ``member`` says of the row ``id`` the class, ``trigger_id``,
    its time, and the window if it is serious; so pairs that are not ``whole`` can be read as well.
    """
    rows = members.select(
        F.lit("member").alias("kind"), F.col("class_id").alias("trigger_id"), "id", F.lit(None).cast("double").alias("similarity"),
        F.lit(None).cast("boolean").alias("whole"), "event_epoch", F.col("window_s").cast("double").alias("window_s"))
    return rows.unionByName(pairs.withColumn("kind", F.lit("pair")), allowMissingColumns=True)


def expanded(pairs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(trigger_id, id, similarity) of the single rows behind pairs of classes: as many as there are links."""
    ends = classes.select(F.col("class_id").alias("trigger_id"), "window_s")
    own = members.select(F.col("class_id").alias("trigger_id"), F.col("id").alias("trigger"), F.col("event_epoch").alias("at"))
    other = members.select(F.col("class_id").alias("id"), F.col("id").alias("row"), F.col("event_epoch").alias("met"))
    both = pairs.join(ends, "trigger_id").join(own, "trigger_id").join(other, "id")
    return both.filter((F.col("trigger") != F.col("row")) & (F.abs(F.col("met") - F.col("at")) <= F.col("window_s"))).select(
        F.col("trigger").alias("trigger_id"), F.col("row").alias("id"), "similarity")
