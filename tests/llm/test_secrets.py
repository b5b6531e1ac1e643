import random
import re

import pytest
from pyspark.sql import functions as F

from vigilark.llm import secret_scan as secrets

KINDS = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
         ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]


def by_hand(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        flags = re.I | re.A if kind == "assign" else 0
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out))


TEXTS = [None, "", "password=abcdef", 'PassWord" : "abc', "secret=token:abcdefgh", "token==abcdef api-key api_key=x1x2x3",
         "é😀 Secret: 0123456789abcdef01234567 😀 AKIA" + "Z" * 16, "AKIAAKIA" + "1" * 16 + " AKIA123",
         "0123456789abcdef0123456", "passwd='aaaaaa'" * 3, "ſecret=abcdef toKen=abcdef",
         " ".join(f"password=p{i:07d}" for i in range(1500)), "a" * 24, "x" + "ab" * 700_000 + "x"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = "the thing another ordinary sentence continues without interruption nevertheless".split()
    plain = [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    key = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = ["see " + "".join(rng.choices(key, k=30)) + " there" for _ in range(20)]
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS + plain + planted)] + [(None, "token: abcdefg", "x", 1)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, base int")


@pytest.fixture(scope="module")
def models(docs):
    return secrets.train(docs)


def test_base_spans_equal_a_plain_search(docs, models):
    found = secrets.scan(docs, models)
    got = found.select("doc_id", secrets.written_spans(F.col("base")).alias("b")).collect()
    want = sorted((str(r.doc_id), by_hand(r.text or "")) for r in docs.collect())
    assert sorted((str(r.doc_id), r.b) for r in got) == want


def test_models_tell_random_strings_from_words(docs, models):
    rows = secrets.scan(docs, models).select("doc_id", secrets.written_spans(F.col("spans")).alias("s")).collect()
    spans = {r.doc_id: r.s for r in rows if r.doc_id is not None}
    first = len(TEXTS)
    assert all(spans[i] == "" for i in range(first, first + 40))
    hits = sum("markov:4:34" in spans[i] for i in range(first + 40, first + 60))
    assert hits >= 18


def test_redaction_leaves_no_secret(docs, models):
    clean = docs.withColumn("text", secrets.redacted(F.col("text"), models))
    rows = secrets.scan(clean, models).collect()
    assert all(not r.spans for r in rows)
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert kept[0] is None and kept[1] == "" and kept[2] == "[secret]"
    assert kept[3] == 'PassWord" : "abc'


def test_empty_table(docs, spark):
    none = docs.limit(0)
    assert secrets.scan(none, secrets.train(none)).collect() == []


def test_prefix_sums(spark):
    for n in (0, 1, 3, 4, 17, 70):
        values = list(range(n))
        frame = spark.createDataFrame([(values,)], "v array<bigint>")
        got = frame.select(secrets.prefix_sums(F.col("v"), 4).alias("p")).first().p
        assert got == [sum(values[:i + 1]) for i in range(n)]
