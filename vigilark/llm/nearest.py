"""Nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are dealt into blocks; every query block meets every candidate block in a tile.
A tile multiplies int8 codes, bounds what rounding can have changed, and recomputes in double precision
only the pairs that can still be among a query's best. Heaps of each tile's best are merged by query.

For q = sq*(iq + eq) and c = sc*(ic + ec): |q.c - sq*sc*iq.ic| <= |q - sq*iq| |c| + sq|iq| |c - sc*ic|, so
approximate scores and norms of codes and rounding errors give a lower and an upper limit for each pair.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
rows without id; only vectors of one length are compared; a repeated id is a candidate for itself no more
than once per row, and rows of the query's own id are left out; ties go to the smaller id; with fewer
candidates than k, all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (doubles), is_query and dims of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"),
                          F.coalesce(is_query, F.lit(False)).alias("is_query"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()
                       & finite & F.exists("vector", lambda x: x != 0)).withColumn("dims", F.size("vector"))


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, and the norms of the vector, of the coded vector and of the rounding error."""
    scale = np.abs(vectors).max(axis=1) / 127
    # A vector of tiny numbers may have no scale of its own.
    scale[scale == 0] = np.finfo(float).tiny
    with np.errstate(over="ignore", invalid="ignore"):
        code = np.clip(np.rint(vectors / scale[:, None]), -127, 127).astype(np.int8)
    near = code * scale[:, None]
    norm = lambda x: np.sqrt((x * x).sum(axis=1))
    return code, scale, norm(vectors), norm(near), norm(vectors - near)


def exact(query: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same way wherever its vector stands."""
    return (found * query).sum(axis=1)


class Heap:
    """The k best (score, id) per query so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id = np.zeros(0), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        best = np.lexsort((ids, -score))[:self.k]
        self.score, self.id = score[best], ids[best]

    @property
    def floor(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -np.inf


def tile(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, found: np.ndarray, heaps: list[Heap],
         strip: int = 2048) -> None:
    """Add the candidates ``found`` to the heaps of ``queries``."""
    qc, qs, qn, qa, qe = codes(queries)
    for at in range(0, len(found), strip):
        part, ids = found[at:at + strip], c_ids[at:at + strip]
        cc, cs, cn, _, ce = codes(part)
        # int8 products summed in float32 are exact up to 1040 dimensions; beyond, double precision is.
        kind = np.float32 if queries.shape[1] <= 1000 else np.float64
        product = (qc.astype(kind) @ cc.T.astype(kind)).astype(np.float64)
        near = product * qs[:, None] * cs[None, :]
        slack = (qe[:, None] * cn[None, :] + qa[:, None] * ce[None, :]) * (1 + 1e-9) + 1e-12 * qn[:, None] * cn[None, :]
        near[q_ids[:, None] == ids[None, :]] = -np.inf
        low = near - slack
        k = heaps[0].k
        for i, heap in enumerate(heaps):
            # At least k candidates reach the k-th largest lower limit.
            least = np.partition(low[i], -k)[-k] if len(ids) >= k else -np.inf
            alive = np.flatnonzero((near[i] + slack[i] >= max(least, heap.floor)) & (near[i] > -np.inf))
            if len(alive):
                heap.add(exact(queries[i], part[alive]), ids[alive])


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           query_rows: int = 1000, candidate_rows: int = 10_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with the other rows.

    A tile holds about ``query_rows`` x ``candidate_rows`` vectors. The numbers of blocks follow from the
    counts by length of vector; each vector is sent once to every block of the other side.
    """
    rows = usable(vectors, is_query, id_col, vector_col)
    counts = rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).select(
        "dims", F.ceil(F.col("n") / candidate_rows).cast("int").alias("c_blocks"),
        F.greatest(F.ceil(F.col("q") / query_rows), F.lit(1)).cast("int").alias("q_blocks"))
    dealt = rows.join(F.broadcast(counts), "dims").withColumns({
        "q_block": F.pmod(F.xxhash64("id", F.lit(1)), "q_blocks").cast("int"),
        "c_block": F.pmod(F.xxhash64("id", F.lit(2)), "c_blocks").cast("int")})
    asked = dealt.filter("is_query").dropDuplicates(["id", "vector"]).select(
        "dims", "q_block", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)).alias("c_block"),
        F.lit(True).alias("asks"), "id", "vector", F.xxhash64("vector").alias("asked"))
    offered = dealt.select(
        "dims", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q_block"), "c_block",
        F.lit(False).alias("asks"), "id", "vector", F.lit(0).cast("long").alias("asked"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        ids, asked = rows.column("id").to_numpy(), rows.column("asked").to_numpy()
        flat = rows.column("vector").combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
        matrix = flat.to_numpy().reshape(len(ids), key[0].as_py())
        order = np.lexsort((ids, ~asks))
        ids, asked, matrix, n = ids[order], asked[order], matrix[order], int(asks.sum())
        heaps = [Heap(k) for _ in range(n)]
        if n:
            tile(ids[:n], matrix[:n], ids[n:], matrix[n:], heaps)
        return pa.table({
            "query_id": pa.array(np.repeat(ids[:n], [len(h.id) for h in heaps]), pa.int64()),
            "asked": pa.array(np.repeat(asked[:n], [len(h.id) for h in heaps]), pa.int64()),
            "vec_id": pa.array(np.concatenate([h.id for h in heaps] or [np.zeros(0, np.int64)]), pa.int64()),
            "score": pa.array(np.concatenate([h.score for h in heaps] or [np.zeros(0)]), pa.float64())})

    best = asked.unionByName(offered).groupBy("dims", "q_block", "c_block").applyInArrow(
        run, "query_id long, asked long, vec_id long, score double")
    # Heaps of several blocks meet: each task keeps k rows per query before the shuffle as well.
    place = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
