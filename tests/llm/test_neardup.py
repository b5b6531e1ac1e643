import random

import numpy as np
import pyarrow as pa

from vigilark.llm import neardup, shingles


def by_hand(rows, width=5, percent=75):
    import re
    sets = {}
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = ({tuple(words[i:i + width]) for i in range(len(words) - width + 1)}
                     if len(words) >= width else {tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) > 0:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in docs}


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "one", "One", "one two", "two one", "a b c d e", "A B C D E", "a b c d e a b c d e"]
    for family in range(6):
        base = rng.choices(words, k=rng.choice([30, 120, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 4, 60])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("\n".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    shared = rng.choices(words, k=60)
    texts += [" ".join(shared + rng.choices(words, k=60)) for _ in range(40)]
    texts += [" ".join(rng.choices(words, k=80)) for _ in range(60)]
    texts += [texts[30]] * 50
    rng.shuffle(texts)
    return [(i * 3, t, "x", 1, True) for i, t in enumerate(texts)]


COLUMNS = "doc_id long, text string, component_id string, band int, kept boolean"


def test_equals_all_pairs(spark):
    rows = corpus()
    got = neardup.groups(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == by_hand(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(40))
    rows = [(1, long, "", 0, True), (1, long, "", 0, True), (None, long, "", 0, True), (None, None, "", 0, True), (2, long, "", 0, True)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.groups(spark.createDataFrame(rows, COLUMNS)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (None, None, True), (2, 1, False)], key=str)
    assert neardup.groups(spark.createDataFrame([], COLUMNS)).collect() == []


def test_an_id_with_several_texts_is_one_document(spark):
    rng = random.Random(2)
    a, b, c, d = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(4))
    near = a.replace(a.split()[30], "other", 1)
    rows = [(3, a), (5, a), (5, b), (7, b), (9, near), (9, c), (11, c), (20, d), (21, d), (22, d + " more"), (30, a[::-1]), (30, b[::-1]), (31, b[::-1])]
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3, True), *((i, 3, False) for i in (5, 7, 9, 11)), (20, 20, True), (21, 20, False), (22, 20, False),
                   (30, 30, True), (31, 30, False)}


def test_tiles_find_what_hubs_miss(spark):
    # A chain: neighbours are similar, ends are not, so no hub is linked with all members of its bucket.
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[k:k + 200]), "", 0, True) for i, k in enumerate(range(0, 150, 10))]
    got = neardup.groups(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {r.component_id for r in got} == {0}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    sketch = shingles.Sketcher(256)
    for size, share in ((1, 1.0), (3, 1.0), (40, 0.5), (1000, 0.75), (5000, 0.9)):
        diffs = []
        for _ in range(20):
            both = rng.integers(0, 2**63, int(size * share)).astype(np.uint64)
            rest = [rng.integers(0, 2**63, size - len(both)).astype(np.uint64) for _ in range(2)]
            a, b = (sketch(np.unique(np.concatenate([both, r]))) for r in rest)
            assert (a != np.uint64(2**64 - 1)).all()
            diffs.append((a == b).mean() - len(both) / (2 * size - len(both)))
        assert abs(np.mean(diffs)) < 0.03 and np.max(np.abs(diffs)) < 0.15


def test_shingle_sets():
    texts = pa.array(["a b c d e f", " A  b\tC d E ", "a b", "b a", None, "", "a b c d e f a b c d e f"])
    sets = shingles.shingle_sets(texts, 5)
    assert [len(s) for s in sets] == [2, 1, 1, 1, 0, 0, 6]
    assert set(sets[1]) <= set(sets[0]) and sets[2][0] != sets[3][0]
    assert len(set(sets[0]) & set(sets[6])) == 2
