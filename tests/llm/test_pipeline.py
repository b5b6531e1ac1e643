import random
from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm import test_neardup, test_packing
from vigilark.llm import language, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, nth int"


def corpus():
    rng = random.Random(9)
    kinds = {"xa": ["th", "er", "on", "ing", "the"], "yb": ["é", "le", "que", "eau", "ai"]}
    texts = []
    for i in range(160):
        lang = rng.choice(["xa", "xa", "yb"])
        words = ["".join(rng.choices(kinds[lang], k=rng.randint(1, 3))) + str(rng.randint(0, 9)) * (rng.random() < 0.02) for _ in range(120)]
        if i % 8 == 0:
            words = [w.upper() + "!!" for w in words]
        if i % 9 == 1:
            words[50] = f"password=Zx{i}9k2LmQ8"
        texts.append((" ".join(words), lang))
        if i % 10 == 2:
            for _ in range(rng.choice([1, 6])):
                copy = list(words)
                copy[rng.randrange(120)] = "changed"
                texts.append((" ".join(copy), lang))
    texts += [(None, "xa"), ("", "xa"), ("1 2 3", None), ("short the on", "xa")]
    rows = [(i, t, lang, "src", len(t or ""), True, 1) for i, (t, lang) in enumerate(texts)]
    return rows + [rows[5], (None, rows[7][1] + " more", "xa", "src", 1, True, 1)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(not (r[1] or "!!").endswith("!!")), 0) for r in rows if r[0] is not None and r[0] % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, outs = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/stage{len(outs)}.parquet"
        out.write.parquet(path)
        outs.append((docs, out))
        docs = spark.read.parquet(path)
    return folder, outs, docs


def by_row(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_do_what_their_operators_say(spark, made):
    folder, outs, packed = made
    for before, after in outs[:-1]:
        assert after.columns == before.columns
    # Language: the operator's verdict, row by row.
    docs = outs[0][0]
    found = language.identify(docs, language.train(docs), column="x").collect()
    assert by_row(outs[0][1]) == sorted((tuple(r)[:-1] for r in found if r.x.pred != "und" and r.x.score >= 0.5), key=str)
    assert len(found) - outs[0][1].count() == 3
    # Quality: the learned rules and the base rule on plain counts.
    docs = outs[1][0]
    rules = quality.learn(*quality.labelled(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert rules
    kept = [r for r in docs.collect() if len(r.text.split()) >= 50 and not r.text.endswith("!!")]
    assert by_row(outs[1][1]) == sorted(map(tuple, kept), key=str)
    # Near duplicates: one document of each group of the all-pairs comparison.
    docs = outs[2][0].collect()
    groups = test_neardup.by_hand([tuple(r) for r in docs if r.doc_id is not None])
    want = {tuple(r) for r in docs if r.doc_id is None or groups[r.doc_id][1] == r.doc_id}
    assert by_row(outs[2][1]) == sorted(want, key=str)
    assert 0 < len(want) < len(docs)
    # Secrets: nothing is left to find, clean texts are as they were.
    before, after = {r.doc_id: r for r in outs[3][0].collect()}, {r.doc_id: r for r in outs[3][1].collect()}
    assert before.keys() == after.keys()
    for i, r in before.items():
        if "password=" in r.text:
            assert "password=" not in after[i].text and after[i].n_chars == len(after[i].text)
        else:
            assert after[i] == r
    # Packing: every document once, gapless.
    ends = defaultdict(int)
    for r in sorted(packed.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    texts = {r.doc_id: r.text for r in outs[4][0].collect()}
    pieces = defaultdict(int)
    for r in packed.collect():
        pieces[r.doc_id] += r.length
    assert {i: n for i, n in pieces.items()} == {i: len(test_packing.ids_of(t)) for i, t in texts.items()}


def test_run_is_the_stages_in_order(spark, made):
    folder, _, packed = made
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert by_row(corpus_pipeline.run(spark, folder).select(columns)) == by_row(packed.select(columns))


def test_repeated_ids_keep_one_text_of_each_group(spark):
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words[:60]), " ".join(words[100:160])
    rows = [(3, a, 1), (5, a, 1), (5, b, 1), (7, b, 1), (8, a + " x", 1), (9, " ".join(words[200:260]), 1), (9, " ".join(words[200:260]), 1)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, nth int"), "").collect()
    # 5 ties both texts to one group, whose smallest id stays; a row that repeats stays once.
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, a), (9, rows[5][1])]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
