"""Keyword search against brute force; no row per pair of a document and a query leaves a task."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vigilark.operators import retrieval


def texts(n, seed, words=60, copies=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i:02d}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    out = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 25))) for _ in range(n - copies)]
    return out + ["w00 w01 w00 rare"] * copies


def brute(corpus, asked, k):
    def terms(text):
        found = text.split()
        return Counter(found + [f"{a} {b}" for a, b in zip(found, found[1:])])

    counts = {d: terms(t) for d, t in corpus}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(corpus)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(count):
        known = {t: n * idf[t] for t, n in count.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in known.values()))
        return {t: w / norm for t, w in known.items()}

    docs = {d: unit(c) for d, c in counts.items()}
    out = []
    for q, text in asked:
        query = unit(terms(text))
        scores = [(-round(sum(w * doc[t] for t, w in query.items() if t in doc), 9), d)
                  for d, doc in docs.items() if query.keys() & doc.keys()]
        out += [(q, d, round(-s, 6), rank + 1) for rank, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"QUERY_TERMS": 300, "DOCUMENT_TERMS": 400, "QUERY_ROWS": 7, "DOCUMENT_ROWS": 9,
                                        "DENSE_TERMS": 3, "PRODUCTS": 5, "SPARSE_COST": 8}])
def test_search_matches_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(retrieval, name, value)
    corpus = list(enumerate(texts(150, 1, copies=40) + ["", "x", "alone apart"]))
    asked = [(f"q{i}", t) for i, t in enumerate(texts(40, 2, copies=5) + ["nothing known", "alone"])]
    found = retrieval.tfidf_search(spark.createDataFrame(corpus, "doc_id long, text string"),
                                   spark.createDataFrame(asked, "query_id string, text string"), k=7)
    got = sorted((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in found.collect())
    assert got == brute(corpus, asked, 7)


def test_norms_are_the_same_however_many_terms_are_sent(spark):
    counts = spark.createDataFrame([(d, f"t{t}", 1 + (d * t) % 3) for d in range(30) for t in range(d % 7 + 1)],
                                   "doc_id long, term string, tf long")
    terms = retrieval.vocabulary(counts, retrieval.F.lit(30))
    some, none, every = ({r.doc_id: round(r.norm, 9) for r in retrieval.text_norms(counts, terms, "doc_id", heavy).collect()}
                         for heavy in (8, 1, 1 << 16))
    assert len(some) == 30 and some == none == every


def test_pairs_leave_a_task_only_as_best_rows(spark):
    """Sixty queries share a word with each of 400 documents: 24000 pairs, of which 180 rows may go on."""
    docs = spark.createDataFrame([(d, [1, 2 + d % 5], [1, 1], 1.0) for d in range(400)],
                                 "doc long, terms array<long>, amounts array<int>, norm double")
    asked = spark.createDataFrame([(q, [1], [1.0]) for q in range(60)], "query long, terms array<long>, amounts array<double>")
    found = retrieval.best_documents(asked, docs, 3).collect()
    assert sorted((r.query, r.doc) for r in found) == [(q, d) for q in range(60) for d in range(3)]


def test_long_spans_of_documents_hand_on_few_rows(spark, monkeypatch):
    """Eighty chunks of documents pass in at most two spans a core, and only a span hands on its best rows."""
    monkeypatch.setattr(retrieval, "DOCUMENT_TERMS", 10)
    docs = spark.createDataFrame([(d, [1, 2 + d % 5], [1, 1], 1.0) for d in range(400)],
                                 "doc long, terms array<long>, amounts array<int>, norm double")
    asked = spark.createDataFrame([(q, [1, 2 + q % 5], [1.0, 0.5]) for q in range(60)], "query long, terms array<long>, amounts array<double>")
    found = retrieval.best_documents(asked, docs, 3).collect()
    assert len(found) <= 60 * 3 * 2 * spark.sparkContext.defaultParallelism
    best = {q: sorted((-r.score, r.doc) for r in found if r.query == q)[:3] for q in range(60)}
    assert best == {q: [(-1.5, d) for d in range(q % 5, 15, 5)] for q in range(60)}


def sides(n_queries, n_docs, words, seed, longest=12):
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, words + 1)

    def terms(n):
        return [rng.choice(words, rng.integers(1, longest), False, share / share.sum()).tolist() for _ in range(n)]

    asked, docs = terms(n_queries), terms(n_docs - n_docs // 4)
    docs += [docs[0]] * (n_docs - len(docs))  # many copies, so that ids break ties
    return (pa.table({"query": [f"q{i}" for i in range(n_queries)], "terms": asked, "amounts": [rng.random(len(x)).tolist() for x in asked]}),
            pa.table({"doc": range(n_docs), "norm": [math.sqrt(len(x)) for x in docs], "terms": docs, "amounts": [[1.0] * len(x) for x in docs]}))


@pytest.mark.parametrize("limits", [{}, {"FEW_CELLS": 0}, {"FEW_CELLS": 1, "QUERY_ROWS": 16, "DOCUMENT_ROWS": 64, "DOCUMENT_TERMS": 0},
                                    {"BOUND_COLUMNS": 4, "DENSE_TERMS": 2, "PRODUCTS": 50, "DOCUMENT_ROWS": 64, "SPARSE_COST": 4}, {"longest": 90_000}])
def test_best_are_those_of_the_whole_product(monkeypatch, limits):
    for name, value in limits.items():
        if name != "longest":
            monkeypatch.setattr(retrieval, name, value)
    queries, documents = sides(50, 600, 80, 5)
    if "longest" in limits:  # then short floats are not sure enough
        terms = list(range(80, 80 + limits["longest"]))
        queries = pa.concat_tables([queries, pa.table({"query": ["long"], "terms": [terms], "amounts": [[0.5] * len(terms)]})])
    best = retrieval._Best(queries, 4)
    assert best.kind is (np.float64 if "longest" in limits else np.float32)
    for start in range(0, 600, 150):
        best.meet(documents.slice(start, 150))
    got = sorted((r["query"], r["doc"], round(r["score"], 8)) for b in best.rows((pa.string(), pa.int64())) for r in b.to_pylist())
    asked, held = ([dict(zip(r["terms"], r["amounts"])) for r in t.to_pylist()] for t in (queries, documents))
    norms, expected = documents.column("norm").to_pylist(), []
    for q, name in zip(asked, queries.column("query").to_pylist()):
        scores = [(-round(sum(w * d[t] / n for t, w in q.items() if t in d), 9), i) for i, (d, n) in enumerate(zip(held, norms)) if q.keys() & d.keys()]
        expected += [(name, i, round(-s, 8)) for s, i in sorted(scores)[:4]]
    assert got == sorted(expected)


def test_a_block_is_met_only_by_queries_it_can_serve(monkeypatch):
    """Two languages share a rare word of no weight: once a query has good documents, blocks of the other one are left out."""
    met = []
    cells = retrieval._Best._cells
    monkeypatch.setattr(retrieval._Best, "_cells", lambda self, rows, *a: (met.append(len(rows)), cells(self, rows, *a)))
    monkeypatch.setattr(retrieval, "DOCUMENT_ROWS", 50)
    queries = pa.table({"query": range(40), "terms": [[i % 2, 2] for i in range(40)], "amounts": [[1.0, 0.01]] * 40})
    documents = pa.table({"doc": range(400), "norm": [1.0] * 400, "terms": [[i % 2, 2] for i in range(400)], "amounts": [[1.0, 1.0]] * 400})
    best = retrieval._Best(queries, 3)
    best.meet(documents.slice(0, 100))
    assert sum(met) == 2 * 40
    met.clear()
    best.meet(documents.slice(100))
    assert sum(met) == 6 * 20
    assert {tuple(x) for x in best.place.tolist()} == {(0, 2, 4), (1, 3, 5)}


def test_a_term_moves_once_for_each_chunk_of_texts(spark):
    """Two hundred copies of a text hold its seven terms 1400 times; what moves are seven names a chunk."""
    docs = spark.createDataFrame([(i, "aa bb cc dd") for i in range(200)], "doc_id long, text string").coalesce(1)
    found = retrieval.coded_texts(docs, "doc_id", 4, []).collect()
    names = sorted((n, c) for r in found if r.bin is not None for n, c in zip(r.names.split("\n"), r.df))
    chunks = {r.chunk for r in found}
    assert len(names) == 7 * len(chunks) and sum(c for _, c in names) == 1400
    assert sorted({n for n, _ in names}) == ["aa", "aa bb", "bb", "bb cc", "cc", "cc dd", "dd"]
    assert sum(len(r.steps) for r in found if r.bin is None) == 1400


@pytest.mark.parametrize("words_of_chunk", [1 << 20, 30])
def test_chunks_give_what_rows_of_texts_and_terms_give(spark, monkeypatch, words_of_chunk):
    monkeypatch.setattr(retrieval, "CHUNK_WORDS", words_of_chunk)
    corpus = spark.createDataFrame(list(enumerate(texts(120, 3, copies=30) + ["", None, "alone apart"])), "doc_id long, text string")
    asked = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts(20, 4) + ["nothing known", None, "alone w03"])],
                                  "query_id string, text string")
    sides = []
    for build in (retrieval._coded_sides, retrieval._counted_sides):
        queries, documents = build(corpus, asked, "doc_id", "query_id", ["w01"], None)
        sides.append(({r.query: sorted(round(x, 9) for x in r.amounts) for r in queries.collect()},
                      {r.doc: (round(r.norm, 9), sorted(r.amounts)) for r in documents.collect()}))
    assert sides[0] == sides[1] and len(sides[0][1]) > 100


def test_rows_of_one_id_are_one_text(spark):
    corpus = [(1, "aa bb"), (1, "bb cc"), (2, "bb dd"), (None, "aa")]
    found = retrieval.tfidf_search(spark.createDataFrame(corpus, "doc_id long, text string"),
                                   spark.createDataFrame([("q", "bb cc")], "query_id string, text string")).collect()
    assert [(r.doc_id, r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
