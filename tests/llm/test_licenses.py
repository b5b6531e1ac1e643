import random
import re

import pytest

from vigilark.llm import licenses

UPPER = str.maketrans(licenses.UPPER, licenses.LOWER)


def split_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(UPPER)) if w]


def held_by_hand(text, templates, percent):
    """(block, template, overlap) by comparing every block with every template."""
    out = []
    for i, block in enumerate(re.split(r"[.!?][\x09-\x0D\x20]+|\n[\x09\x20]*\n", (text or "").translate(UPPER))):
        have = set(split_words(block))
        for j, (_, t) in enumerate(templates):
            want = set(split_words(t))
            if want and 100 * len(want & have) >= percent * len(want):
                out.append((i, j, len(want & have)))
    return out


def by_hand(doc_id, text, templates, percent):
    w = split_words(text or "")
    base = [(i, label) for label, p in licenses.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    best, labels = 0.0, {label for _, label in base}
    blocks = {}
    for i, j, n in held_by_hand(text, templates, percent):
        blocks.setdefault(i, []).append((n / len(set(split_words(templates[j][1]))), n, templates[j][0]))
    for hits in blocks.values():
        best = max(best, max(hits)[0])
        labels |= {h[2] for h in hits if h[:2] == max(hits)[:2]}
    starts = [i for i, _ in base]
    return (doc_id, len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base})),
            ",".join(sorted(labels)), 1.0 if base else best)


def sample():
    rng = random.Random(8)
    tokens = [w for _, t in licenses.TEMPLATES for w in t.split()]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            t = rng.choice(licenses.TEMPLATES)[1].split()
            if kind < 0.5:
                parts.append(" ".join(w for w in t if rng.random() < 0.88))
            elif kind < 0.7:
                rng.shuffle(t)
                parts.append(" Öl ".join(t).upper())
            else:
                parts.append(" ".join(rng.choices(tokens, k=rng.randint(1, 40))))
        rows.append((i, rng.choice([". ", "\n\n", "\n", "; "]).join(parts), i, "x"))
    long = "word " * 40_000 + "MIT-License. " + "the of " * 20_000 + "General public\nLICENSE"
    return rows + [(900, None, 0, ""), (901, "", 0, ""), (902, "...", 0, ""), (None, rows[0][1], 0, ""), (3, rows[3][1], 0, ""),
                   (903, long, 0, ""), (904, "mıt lıcense MİT LİCENSE", 0, ""), *[(1000 + i, "Released under the MIT License.", 0, "") for i in range(120)]]


@pytest.mark.parametrize("percent", [80, 100, 45])
def test_equals_comparing_all(spark, percent):
    rows = sample()
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int, label string")
    got = licenses.labelled(licenses.scan(frame, percent=percent)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted((by_hand(i, t, licenses.TEMPLATES, percent) for i, t, *_ in rows), key=key)


def test_every_pair_is_found(spark):
    rows = sample()[:120]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int, label string")
    order, ranked = licenses.ordered(frame, percent=60)
    found = licenses.pairs(frame, order, ranked)
    got = sorted((r.digest, r.block, r.template, r.overlap) for r in found.collect())
    import hashlib
    want = sorted((hashlib.sha256(t.encode()).hexdigest(), i, j, n) for _, t, *_ in rows for i, j, n in held_by_hand(t, licenses.TEMPLATES, 60))
    assert want and got == want


def test_rare_words_come_first(spark):
    frame = spark.createDataFrame([(1, "the license"), (2, "the a"), (3, "the")], "doc_id long, text string")
    order, ranked = licenses.ordered(frame, (("x", "the a license mit the"), ("y", "..")), 50)
    assert order == ["mit", "a", "license", "the"]
    assert ranked == [licenses.Template(0, "x", ["mit", "a", "license", "the"], 2)]


def test_no_rows_no_templates(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.labelled(licenses.scan(frame)).collect() == []
    frame = spark.createDataFrame([(1, "an MIT license.")], "doc_id long, text string")
    assert tuple(licenses.labelled(licenses.scan(frame, ())).first()) == (1, 3, 1, 1, 1, "mit", "mit", 1.0)
    with pytest.raises(ValueError, match="templates"):
        licenses.word_sets((("x", " ".join(map(str, range(licenses.MOST_WORDS + 1)))),))


def test_no_python_in_the_plan(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frame = licenses.labelled(licenses.scan(docs))
    assert "Python" not in (plan := frame._jdf.queryExecution().toString()) and "Arrow" not in plan
