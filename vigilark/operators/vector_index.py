"""An index beside the vector table: coarse cells, int8 residuals, and search by bounds.

Centres are fitted on a bounded sample. The index has a small row per vector: its cell, the residual to the
cell's centre in int8, the residual's length and what rounding changed. For a trigger q (all of length 1),
a cell with centre m and longest residual r holds nothing above q.m + r, so a trigger probes only cells whose
bound reaches the threshold. In a probed cell q.m + scale * q.code + error bounds each row; only rows
that can still pass are compared in full. Both bounds are sound, so no neighbour above the threshold is lost,
however the sample was drawn: a bad sample costs work, not results.

New vectors are appended to the folders of their cells; nothing else is read or written.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark import dims
from vigilark.operators import similarity

INDEX_SCHEMA = ("id string, event_epoch double, bucket long, cell int, code binary, scale double, reach double, "
                "slack double")
#: What rounding in double precision and of shown similarities may change.
MARGIN = 1e-8


class Index(NamedTuple):
    centres: np.ndarray
    rows: DataFrame


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def fit_centres(vectors: DataFrame, cells: int = 256, sample: int = 50_000, rounds: int = 10) -> np.ndarray:
    """Centres of k-means on at most ``sample`` vectors, those with the smallest hash of their id."""
    held = vectors.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow()
    if not held.num_rows:
        return np.zeros((0, 0))
    column = held.column("embedding").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    points = _unit(column, len(column[0]))
    centres = points[:: max(1, len(points) // cells)][:cells].copy()
    for _ in range(rounds):
        near = np.argmax(points @ centres.T - (centres ** 2).sum(axis=1) / 2, axis=1)
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def index_rows(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """The index rows of vectors (id, event_epoch, embedding)."""
    dim = centres.shape[1]

    def code(batches):
        for batch in batches:
            points = _unit(batch.column("embedding"), dim)
            cell = np.argmax(points @ centres.T - (centres ** 2).sum(axis=1) / 2, axis=1)
            rest = points - centres[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-300) / 127
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            slack = np.linalg.norm(rest - codes * scale[:, None], axis=1)
            seconds = batch.column("event_epoch").to_numpy()
            flat = pa.py_buffer(codes.tobytes())
            ends = pa.py_buffer((np.arange(len(codes) + 1) * dim).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("event_epoch"),
                pa.array(np.floor(seconds / similarity.BUCKET_S).astype(np.int64)), pa.array(cell.astype(np.int32)),
                pa.Array.from_buffers(pa.binary(), len(codes), [None, ends, flat]), pa.array(scale),
                pa.array(np.linalg.norm(rest, axis=1)), pa.array(slack)],
                names=["id", "event_epoch", "bucket", "cell", "code", "scale", "reach", "slack"])

    return vectors.filter(F.size("embedding") == dim).select("id", "event_epoch", "embedding").mapInArrow(code, INDEX_SCHEMA)


def build(vectors: DataFrame, path: str, cells: int = 256, sample: int = 50_000) -> Index:
    """Fit, and write the centres and the index rows, a folder per cell."""
    spark = vectors.sparkSession
    centres = fit_centres(vectors, cells, sample)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    insert(vectors, path, centres)
    return read(spark, path)


def insert(vectors: DataFrame, path: str, centres: np.ndarray | None = None) -> None:
    """Append the rows of new vectors to their cells' folders."""
    centres = _centres(vectors.sparkSession, path) if centres is None else centres
    index_rows(vectors, centres).write.mode("append").partitionBy("cell").parquet(f"{path}/rows")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return np.array([r.centre for r in rows]) if rows else np.zeros((0, 0))


def read(spark: SparkSession, path: str) -> Index:
    return Index(_centres(spark, path), spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/rows"))


def probes(triggers: DataFrame, index: Index, threshold: float) -> DataFrame:
    """The triggers once per cell that may hold a row above the threshold; ``base`` is their product with its centre.

    Triggers need id, event_epoch, window_s and embedding. A row per cell reaches the driver.
    """
    reach = np.full(len(index.centres), -np.inf)
    for r in index.rows.groupBy("cell").agg(F.max("reach").alias("reach")).collect():
        reach[r.cell] = r.reach
    centres, dim = index.centres, index.centres.shape[1]

    def choose(batches):
        for batch in batches:
            points = _unit(batch.column("embedding"), dim)
            base = points @ centres.T
            row, cell = np.nonzero(base + reach >= threshold - MARGIN)
            at = pa.array(row)
            flat = pa.array(points[row].ravel())
            ends = pa.array((np.arange(len(row) + 1) * dim).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("trigger_id").take(at), batch.column("event_epoch").take(at), batch.column("window_s").take(at),
                pa.array(cell.astype(np.int32)), pa.array(base[row, cell]), pa.ListArray.from_arrays(ends, flat)],
                names=["trigger_id", "event_epoch", "window_s", "cell", "base", "embedding"])

    asking = triggers.filter(F.size("embedding") == dim).select(
        F.col("id").alias("trigger_id"), "event_epoch", F.col("window_s").cast("double").alias("window_s"), "embedding")
    return asking.mapInArrow(choose, "trigger_id string, event_epoch double, window_s double, cell int, base double, embedding array<double>")


def _survivors(k: int, threshold: float):
    """The cogroup function: pairs of one cell and chunk whose bound reaches the threshold and the k-th best so far."""
    def screen(triggers: pa.Table, rows: pa.Table) -> pa.Table:
        names, ids = [], []
        if triggers.num_rows and rows.num_rows:
            dim = len(triggers.column("embedding")[0])
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(-1, dim).astype(np.float64).T
            scale, slack = (rows.column(c).to_numpy() for c in ("scale", "slack"))
            seconds, keys = rows.column("event_epoch").to_numpy(), rows.column("id").to_numpy()
            base, centre, width = (triggers.column(c).to_numpy() for c in ("base", "event_epoch", "window_s"))
            own = triggers.column("trigger_id").to_numpy()
            asked = triggers.column("embedding").combine_chunks()
            asked = asked.chunk(0) if isinstance(asked, pa.ChunkedArray) else asked
            asked = asked.flatten().to_numpy().reshape(-1, dim)
            for start in range(0, len(own), 256):
                part = slice(start, start + 256)
                near = base[part][:, None] + (asked[part] @ codes) * scale
                near[np.abs(seconds[None, :] - centre[part][:, None]) > width[part][:, None]] = -np.inf
                floor = np.full(len(near), threshold)
                if near.shape[1] > k:
                    # k rows are at least this near, so others must be able to reach it.
                    floor = np.maximum(floor, np.partition(near - slack, -k, axis=1)[:, -k])
                row, col = np.nonzero(near + slack >= floor[:, None] - MARGIN)
                names.append(own[part][row])
                ids.append(keys[col])
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.array([], object), pa.string())
        return pa.table({"trigger_id": join(names), "id": join(ids)})

    return screen


def candidates(triggers: DataFrame, index: Index, k: int, threshold: float, chunk_rows: int = similarity.CHUNK_ROWS) -> DataFrame:
    """(trigger_id, id) of the pairs that must be compared in full."""
    hours = F.sequence(F.floor((F.col("event_epoch") - F.col("window_s")) / similarity.BUCKET_S),
                       F.floor((F.col("event_epoch") + F.col("window_s")) / similarity.BUCKET_S))
    left = probes(triggers, index, threshold).withColumn("bucket", F.explode(hours))
    return similarity.by_chunks(left, index.rows, ["bucket", "cell"], _survivors(k, threshold), "trigger_id string, id string", chunk_rows)


def _compared(pairs: DataFrame, triggers: DataFrame, vectors: DataFrame) -> DataFrame:
    asked = triggers.select(F.col("id").alias("trigger_id"), F.col("embedding").alias("asked"))
    both = pairs.join(asked, "trigger_id").join(vectors.select(F.col("id").alias("id"), F.col("embedding").alias("held")), "id")

    def compare(batches):
        for batch in batches:
            if batch.num_rows:
                dim = len(batch.column("asked")[0])
                scores = (_unit(batch.column("asked"), dim) * _unit(batch.column("held"), dim)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("trigger_id"), batch.column("id"), pa.array(np.round(scores, similarity.RANK_DIGITS))],
                                                 names=["trigger_id", "id", "similarity"])

    return both.select("trigger_id", "id", "asked", "held").mapInArrow(compare, similarity.PAIR_SCHEMA)


def correlate_indexed(triggers: DataFrame, vectors: DataFrame, index: Index, k: int = dims.K_NEIGHBORS,
                      threshold: float = dims.SIMILARITY_THRESHOLD, chunk_rows: int = similarity.CHUNK_ROWS) -> DataFrame:
    """The rows of :func:`similarity.correlate`, found through the index; ids are unique on either side."""
    timed = triggers if "window_s" in triggers.columns else similarity.with_window(triggers)
    found = _compared(candidates(timed, index, k, threshold, chunk_rows), timed, vectors)
    return similarity.ranked(found.filter(F.col("similarity") >= threshold), k)
