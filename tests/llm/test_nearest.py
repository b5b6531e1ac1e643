import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilark.llm import nearest


def by_hand(rows, k):
    good = [(i, np.array(v, float)) for i, v, *_ in rows
            if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = []
    for q, a in {(i, tuple(v)): (i, v) for i, v in good}.values():
        if q % 5 == 0:
            hits = [(-float((a * b).sum()), i) for i, b in good if i != q and len(b) == len(a)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1000, 10_000), (7, 30)])
def test_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in rng.normal(size=(180, 8)).astype(np.float32)]
    vectors += [vectors[0]] * 60 + [[x * 1e-3 for x in vectors[1]], [1e30] * 8, [1e-30] * 8, [5e-324] * 8]
    vectors += [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [None] + [1.0] * 7, [], [1.0, 2.0], [2.0, 1.0]]
    rows = [(i, v, i % 3, 0) for i, v in enumerate(vectors)] + [(None, vectors[2], 0, 0)]
    rows += [rows[5], rows[5], (10, vectors[11], 0, 0), rows[7]]  # repeated rows, and one id with two vectors
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score int")
    got = nearest.search(frame, F.col("vec_id") % 5 == 0, k=7, query_rows=blocks[0], candidate_rows=blocks[1])
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())
    assert got == by_hand(rows, 7)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.search(frame, F.col("vec_id") % 20 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert nearest.search(one, F.col("vec_id") % 20 == 0).collect() == []


def test_limits_hold(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(50, 33)) * 10.0 ** rng.integers(-8, 8, (50, 1)), rng.normal(size=(60, 33))
    ac, asc, an, aa, ae = nearest.codes(a)
    bc, bsc, bn, _, be = nearest.codes(b)
    near = (ac.astype(float) @ bc.T.astype(float)) * asc[:, None] * bsc
    assert (np.abs(a @ b.T - near) <= ae[:, None] * bn + aa[:, None] * be + 1e-12 * an[:, None] * bn).all()
