import numpy as np
import pytest

from vigilark.llm import whitening


def by_hand(vectors, components, weights):
    """x, n, S, eigenvalues and directions of the fit, all vectors at hand."""
    x = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors]
    fit = list(dict.fromkeys(x))
    w = [1] * len(fit) if weights == "one" else [x.count(v) for v in fit]
    n, sums = sum(w), [sum(a * v[k] for a, v in zip(w, fit)) for k in range(len(fit[0]))]
    c = np.array([[n * v[k] - sums[k] for k in range(len(v))] for v in fit], float) / n
    values, directions = np.linalg.eigh((c * np.array(w)[:, None]).T @ c / n)
    order = np.argsort(-values)[:components]
    return x, n, sums, values[order] / values.sum(), directions[:, order] / np.sqrt(values[order])


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_equals_plain_fit(spark, weights):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 9)) * np.arange(1, 10)).astype(np.float32).tolist()
    vectors += [vectors[7]] * 150 + [vectors[8]] * 3  # a third of the rows are one vector
    bad = [None, [None] + [1.0] * 8, [float("nan")] + [0.0] * 8, [float("-inf")] + [0.0] * 8, []]
    rows = [(i, v, "a", 0) for i, v in enumerate(vectors)] + [(900 + i, v, "b", 0) for i, v in enumerate(bad)]
    rows += [(None, vectors[0], "c", 0), (3, vectors[3], "again", 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, component int")
    vectors += [vectors[0], vectors[3]]
    ids = [*range(len(vectors) - 2), None, 3]
    x, n, sums, shares, directions = by_hand(vectors, 4, weights)
    got = whitening.whiten(frame, components=4, weights=weights).collect()
    assert len(got) == 4 * len(vectors)
    want = {i: (sum((n * a - s) ** 2 for a, s in zip(v, sums)), v) for i, v in zip(ids, x)}
    sign = {}
    for r in got:
        deviation, v = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
        k = r.component - 1
        assert r.explained == pytest.approx(shares[k], rel=1e-9)
        z = float(np.array([n * a - s for a, s in zip(v, sums)], float) / n @ directions[:, k])
        assert r.whitened == pytest.approx(sign.setdefault(k, 1 if r.whitened * z > 0 else -1) * z, abs=1e-8)


def test_lengths_large_entries_and_rank(spark):
    rows = [(1, [1e300, 0.5]), (2, [-1e300, 0.5]), (3, [0.0, 2.0]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(frame).collect()
    assert {r.vec_id for r in got} == {1, 2, 3}  # one distinct vector of three entries has no direction
    assert {r.n for r in got} == {3} and all(r.deviation is None for r in got if r.vec_id < 3)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(frame).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(one).collect() == []


def test_exact_beyond_64_bits():
    x = np.array([[2 ** 52, -2 ** 52], [1, 2]], np.int64)
    sums, n = [5, 7], 10 ** 6
    assert whitening.centred(x, n, sums).tolist() == [[n * v - s for v, s in zip(row, sums)] for row in x.tolist()]
