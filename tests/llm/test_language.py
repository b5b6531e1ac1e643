import random
from collections import Counter

import numpy as np
import pytest

from vigilark.llm import language

SYLLABLES = {"xa": ["th", "er", "on", "ing", "the"], "yb": ["é", "le", "que", "eau", "ai"], "zc": ["ö", "sch", "en", "ß", "und"]}
ODD = [(9001, None), (9002, ""), (9003, "12 34 !!"), (9004, "😀 ١٢"), (9005, "日本語" * 5000), (9006, "𐐀𐐁"), (9007, "a")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        lang = "xa" if i % 3 else rng.choice(["yb", "zc"])
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=3)) for _ in range(rng.choice([4, 30, 200])))
        rows.append((i, text, None if i % 50 == 7 else lang, 0.5))
    rows += [(i, t, "xa", 0.5) for i, t in ODD] + [(None, "the on", "qq", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_held_out_accuracy_and_defined_cases(docs):
    model = language.train(docs, per_language=60)
    assert model.languages == ["xa", "yb", "zc"]
    got = language.identify(docs, model).withColumn("held_out", language.is_held_out()).collect()
    assert len(got) == docs.count()
    good = [r.language.pred == r.lang for r in got if r.held_out and r.lang and r.doc_id is not None and r.doc_id < 9000]
    assert len(good) > 60 and np.mean(good) > 0.97
    found = {r.doc_id: r.language for r in got}
    for i in (9001, 9002, 9003, 9004):
        assert found[i].pred == "und" and found[i].score == 0
    for i in (9005, 9006, 9007):
        assert found[i].pred in model.languages
    assert all(0 <= r.language.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {True}


def test_model_is_sparse_and_the_same_again(docs):
    one, two = language.train(docs), language.train(docs)
    assert (one.weights == two.weights).all() and one.temperature == two.temperature
    assert (one.weights == 0).mean() > 0.5


def test_counts_and_document_frequencies(spark, docs):
    grams = language.Grams(bits=10)
    total = Counter()
    texts = [r.text for r in docs.collect()]
    for text in texts:
        total.update(grams(text or "")[0].tolist())
    seen, n = language.document_frequencies(docs.select("text"), bits=10)
    assert {i: int(c) for i, c in enumerate(seen) if c} == dict(total)
    assert n == sum(any(c.isalpha() for c in t or "") for t in texts)
    # Case and what stands between letters do not matter.
    a, b = grams("Ab, cD"), grams("ab  1 cd")
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_nothing_to_learn(docs):
    model = language.train(docs.limit(0))
    assert language.identify(docs.limit(0), model).collect() == []
    assert {r.language.pred for r in language.identify(docs.limit(3), model).collect()} == {"und"}


def test_temperature_lowers_overconfident_scores():
    rng = np.random.default_rng(0)
    kinds = rng.integers(0, 2, 400)
    scores = np.where(rng.random(400)[:, None] < 0.7, np.eye(2)[kinds], np.eye(2)[1 - kinds]) * 50.0
    assert language.best_temperature(scores, kinds) > 5


def test_every_label_is_learned_and_rows_are_sampled(spark):
    """More labels than any cap, one of them under a single id with many texts: each is predicted."""
    import random
    rng = random.Random(4)
    rows = []
    for k in range(210):
        syllables = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(6)]
        texts = [" ".join("".join(rng.choices(syllables, k=2)) for _ in range(12)) for _ in range(6)]
        rows += [(1_000_003 if k == 7 else k * 10 + i, t, f"l{k:03d}") for i, t in enumerate(texts)]
    rows += [rows[50]] * 30
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(frame, bits=14)
    labels = {r[2] for r in rows}
    seen = {r.lang for r in frame.filter(language.fold("doc_id") != 0).select("lang").distinct().collect()}
    assert set(model.languages) == seen and len(seen) > 200 and seen <= labels
