"""Whitening of embeddings: every distinct vector is fitted and whitened once, then joined back to its rows.

Entries c become x = floor(scale * c) + shift, whole numbers. Rows of one x vector are one group; a group
weighs 1 in the fit, or as much as it has rows (``weights="counts"``). The means are exact sums; a task
centres its vectors exactly, as n*x - S, before it multiplies them (one matrix product a batch, rows scaled
by their weights), and only cells of the product are summed over tasks. The driver solves the eigenvalue
problem of one matrix of dims x dims.

Joining back: vectors that hold over a thousandth of all rows are fewer than a thousand, and are joined by
broadcast; every other vector has few rows, and is joined by shuffle.

Defined cases: rows whose vector is null or holds null or non-finite entries are left out; an entry beyond
2**52 in size after scaling counts as 2**52; vectors of each length are fitted by themselves, an empty vector
has no component; a component whose eigenvalue is not above 1e-12 of the largest (one distinct vector, say)
cannot be whitened and is left out; a deviation beyond 64 bits is null; repeated rows and null ids give
their rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import Batches, written

#: No entry is larger in size, so that it is exact as a double and sums stay within 38 digits.
LARGEST = 2.0 ** 52
#: A vector with more than this share of the rows is joined back by broadcast; there are at most 1 / HOT of them.
HOT = 1e-3


class Fit(NamedTuple):
    """Vectors of one length: weight n, exact sums, directions over their roots (dims x k), shares and the error."""

    n: int
    sums: list[int]
    directions: np.ndarray
    explained: list[float]


def quantised(vector: Column, scale: float = 64.0, shift: int = 1_000_000) -> Column:
    """array<bigint> of floor(scale * c) + shift."""
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(LARGEST)), F.lit(-LARGEST)))
    return F.transform(vector.cast("array<double>"), lambda c: whole(c) + F.lit(shift).cast("long"))


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: float, shift: int) -> DataFrame:
    """id and x of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.col(vector_col).isNotNull() & finite & (F.size(vector_col) > 0)).select(
        F.col(id_col).alias("id"), quantised(F.col(vector_col), scale, shift).alias("x"))


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and the matrix of the vectors of each length in a batch."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, flat[starts[at][:, None] + np.arange(size)]


def centred(x: np.ndarray, fit_n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exactly: int64 where that holds all, Python's whole numbers otherwise."""
    base = np.array([s // fit_n for s in sums], np.int64)
    rest = [s - fit_n * b for s, b in zip(sums, base.tolist())]
    near = x - base
    if (int(np.abs(near).max(initial=0)) + 1) * fit_n < 2 ** 62:
        return near * np.int64(fit_n) - np.array(rest, np.int64)
    return near.astype(object) * fit_n - np.array(rest, object)


def deviations(c: np.ndarray) -> list[int | None]:
    """The sum of squares of each row of n*x - S, exactly; null where that passes 64 bits."""
    if len(c) and c.dtype != object and int(np.abs(c).max()) ** 2 * c.shape[1] < 2 ** 63:
        return (c * c).sum(axis=1).tolist()
    sums = [sum(v * v for v in row) for row in c.tolist()]
    return [s if s < 2 ** 63 else None for s in sums]


def distinct(rows: DataFrame) -> DataFrame:
    """Each x vector once, with the rows that have it."""
    return rows.groupBy("x").agg(F.count("*").alias("copies"))


def _weight(weights: str) -> Column:
    if weights not in ("one", "counts"):
        raise ValueError("weights: one or counts")
    return F.lit(1).cast("long") if weights == "one" else F.col("copies")


def _sums(groups: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and the exact sums by length; tasks add up their vectors, so only dims numbers a task are shuffled."""
    def add(batches: Batches) -> Batches:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for at, x in matrices(batch, "x"):
                w = weight[at]
                fits = int(np.abs(x).max(initial=0)) * int(w.sum()) < 2 ** 62
                part = (x * w[:, None]).sum(axis=0).astype(object) if fits else (x.astype(object) * w[:, None]).sum(axis=0)
                n, s = total.get(x.shape[1], (0, 0))
                total[x.shape[1]] = n + int(w.sum()), s + part
        for dims, (n, s) in total.items():
            yield pa.RecordBatch.from_pydict({
                "dims": pa.array([dims] * dims, pa.int32()), "place": pa.array(range(dims), pa.int32()),
                "n": pa.array([n] * dims, pa.int64()), "total": pa.array([str(v) for v in s])})

    parts = groups.mapInArrow(add, "dims int, place int, n long, total string")
    cells = parts.groupBy("dims", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(cells, key=lambda r: r.place):
        found.setdefault(r.dims, (r.n, []))[1].append(int(r.total))
    return found


def _products(groups: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """The covariance by length: centred vectors, scaled by their weights, one product a batch."""
    def multiply(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy().astype(float)
            for at, x in matrices(batch, "x"):
                n, s = sums[x.shape[1]]
                c = centred(x, n, s).astype(float) / n
                total[x.shape[1]] = total.get(x.shape[1], 0) + c.T @ (c * weight[at][:, None])
        for dims, product in total.items():
            i, j = np.triu_indices(dims)
            yield pa.RecordBatch.from_pydict({
                "dims": pa.array(np.full(len(i), dims, np.int32)), "cell": pa.array((i * dims + j).astype(np.int64)),
                "total": pa.array(product[i, j])})

    cells = groups.mapInArrow(multiply, "dims int, cell long, total double").groupBy("dims", "cell").agg(
        F.sum("total").alias("total")).toArrow()
    found = {}
    kinds, places, totals = (cells.column(c).to_numpy() for c in ("dims", "cell", "total"))
    for dims, (n, _) in sums.items():
        v, mine = np.zeros(dims * dims), kinds == dims
        v[places[mine]] = totals[mine] / n
        v = v.reshape(dims, dims)
        found[dims] = np.triu(v) + np.triu(v, 1).T
    return found


def fit(groups: DataFrame, components: int, weights: str = "one") -> dict[int, Fit]:
    """The fit for each length of vector, from ``distinct`` rows."""
    weighed = groups.select("x", _weight(weights).alias("weight"))
    sums = _sums(weighed)
    fits = {}
    for dims, v in _products(weighed, sums).items():
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        order = [i for i in order if values[i] > 1e-12 * max(values[-1], 0)]
        fits[dims] = Fit(*sums[dims], vectors[:, order] / np.sqrt(values[order]),
                         [float(values[i] / np.trace(v)) for i in order])
    return fits


def _whiten(groups: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """x, copies, dims, deviation and the whitened vector of each distinct x vector."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at, x in matrices(batch, "x"):
                f = fits[x.shape[1]]
                c = centred(x, f.n, f.sums)
                z = (c.astype(float) / f.n) @ f.directions
                yield pa.RecordBatch.from_arrays([
                    batch.column("x").take(pa.array(at)), batch.column("copies").take(pa.array(at)),
                    pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array(deviations(c), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))],
                    names=["x", "copies", "dims", "deviation", "whitened"])

    return groups.mapInArrow(run, "x array<bigint>, copies long, dims int, deviation long, whitened array<double>")


def _identity_errors(whitened: DataFrame, fits: dict[int, Fit], weights: str) -> dict[int, float]:
    """The largest absolute entry of the whitened vectors' covariance less the identity, by length."""
    def multiply(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weight, lengths = batch.column("weight").to_numpy(), batch.column("dims").to_numpy()
            for dims in np.unique(lengths).tolist():
                if k := len(fits[dims].explained):
                    mine = batch.filter(pa.array(lengths == dims)).column("whitened")
                    # The whitened vectors are centred already; the 1 in front sums them up for what rounding leaves.
                    z = np.column_stack([np.ones(len(mine)), mine.flatten().to_numpy().reshape(-1, k)])
                    total[dims] = total.get(dims, 0) + z.T @ (z * weight[lengths == dims][:, None])
        for dims, product in total.items():
            yield pa.RecordBatch.from_pydict({
                "dims": pa.array(np.full(product.size, dims, np.int32)),
                "cell": pa.array(np.arange(product.size, dtype=np.int32)), "total": pa.array(product.ravel())})

    rows = whitened.select("dims", "whitened", _weight(weights).alias("weight"))
    cells = rows.mapInArrow(multiply, "dims int, cell int, total double").groupBy("dims", "cell").agg(F.sum("total").alias("total")).collect()
    errors = {}
    for dims, f in fits.items():
        k = len(f.explained)
        if k:
            square = np.zeros((k + 1) ** 2)
            for r in cells:
                if r.dims == dims:
                    square[r.cell] = r.total
            square = square.reshape(k + 1, k + 1) / f.n
            errors[dims] = float(np.abs(square[1:, 1:] - np.outer(square[0, 1:], square[0, 1:]) - np.eye(k)).max())
    return errors


def whiten(vectors: DataFrame, components: int = 16, weights: str = "one", id_col: str = "vec_id",
           vector_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """id_col, component (from 1), n, deviation, whitened, explained, identity_error for each row and component.

    n is the fit's weight; deviation the exact sum of (n*x - S)**2; whitened the projection of x - S/n on the
    component's direction over the root of its eigenvalue. Broadcasts: the directions, dims x components
    numbers for each length, and the vectors above ``HOT``.
    """
    rows = usable(vectors, id_col, vector_col, scale, shift)
    groups = written(distinct(rows), "whitening-groups")
    fits = fit(groups, components, weights)
    once = written(_whiten(groups, fits), "whitening-vectors")
    errors = _identity_errors(once, fits, weights)
    limit = (groups.agg(F.sum("copies")).first()[0] or 0) * HOT
    hot, others = once.filter(F.col("copies") > limit), once.filter(F.col("copies") <= limit)
    joined = rows.join(F.broadcast(hot), "x").unionByName(
        rows.join(F.broadcast(hot.select("x")), "x", "left_anti").join(others, "x"))
    facts = [(dims, f.n, f.explained, errors.get(dims)) for dims, f in fits.items()]
    shared = vectors.sparkSession.createDataFrame(facts, "dims int, n long, shares array<double>, identity_error double")
    # One row for each length of vector, of which the fit above already holds a matrix each.
    each = joined.join(F.broadcast(shared), "dims")
    return each.select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "shares"))).select(
        F.col("id").alias(id_col), (F.col("pos") + 1).alias("component"), "n", "deviation",
        F.col("col.whitened").alias("whitened"), F.col("col.shares").alias("explained"), "identity_error")
