import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vigilark.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            f = counts.setdefault(lang, Counter())
            f.update(tuple(words[i:i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n, kept = totals[lang], []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {q[i:i + k] for q, b in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)
                   if 100 * b >= 100 * f[q[i:i + k]]}
        for p, a in candidates.items():
            if p not in dropped:
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def sample():
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "New", "york", "Ünï", "a b", "\x01", "x" * 50, "stock", "exchange"]
    rows = []
    for i in range(150):
        words = rng.choices(vocabulary, range(12, 1, -1), k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "\r"]) for w in words)
        rows.append((text + "New York stock exchange" * rng.randint(0, 2), rng.choice(["en", "de", None])))
    return [*rows, *rows[:40], (None, "en"), ("", None), ("...", "fr"), ("one two " * 30_000, "fr")]


@pytest.mark.parametrize(("bits", "most"), [(1 << 26, 1 << 20), (1 << 6, 1 << 20), (1 << 26, 10), (1 << 6, 10)])
def test_equals_plain_counts(spark, bits, most):
    rows = sample()
    frame = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n int, phrase string")
    found = collocations.phrases(frame.repartition(3), 20, filter_bits=bits, most=most)
    got = collocations.standing(collocations.scored(found, 20))
    every = by_hand(rows, 20, 10 ** 6)
    assert every and sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == sorted(
        (g, p, a, lf, r, n, s) for g, _, p, a, lf, r, n, s in every)
    if bits > 64 and most > 10:
        assert sorted(map(tuple, collocations.collocations(frame, 20, top=9).collect())) == by_hand(rows, 20, 9)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_collisions_are_told_apart(spark, monkeypatch, most):
    monkeypatch.setattr(collocations, "mix", lambda x: x & np.uint64(7))
    monkeypatch.setattr(collocations.Grams, "fingerprints", lambda self, k: (
        (self.polynomials(k) & np.uint64(3)) << np.uint64(1) | np.uint64(k > 2), self.words.piece[:max(len(self.words.piece) - k + 1, 0)] == self.words.piece[k - 1:]))
    rows = sample()[:60]
    frame = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.standing(collocations.scored(collocations.phrases(frame, 5, most=most), 5)).collect()
    assert sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == sorted(
        (g, *rest) for g, _, *rest in by_hand(rows, 5, 10 ** 6))


def test_no_rows(spark):
    frame = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(frame).collect() == []
    frame = spark.createDataFrame([(None, None), ("", "en"), (" \n", "en")], "text string, lang string")
    assert collocations.collocations(frame, 1).collect() == []


def test_large_counts_are_exact(spark):
    a, n, lr = 9 * 10 ** 15, 10 ** 16 + 7, 9 * 10 ** 15 + 1
    found = spark.createDataFrame([("en", "", n), ("en", "a b", a), ("en", "a", lr), ("en", "b", lr)], "lang string, phrase string, n long")
    row = collocations.scored(found).first()
    assert row.score == 1000 * a * n // (lr * lr)


def test_polynomials_do_not_depend_on_place():
    h = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    again = collocations.Polynomials(np.concatenate([h[5:], h]))
    found = collocations.Polynomials(h)
    for k in range(1, 6):
        assert (again(k)[len(h) - 5:] == found(k)).all() and (again(k)[:100] == found(k)[5:105]).all()


def test_pieces_end_with_texts():
    t = collocations.tokens(pa.array(["a b", "", "c", None, " d. e"]))
    assert [t.dictionary[c].as_py() for c in t.codes.tolist()] == [b"a", b"b", b"c", b"d", b"e"]
    assert t.row.tolist() == [0, 0, 2, 4, 4] and t.place.tolist() == [0, 1, 0, 0, 1]
    assert t.piece[0] == t.piece[1] and len(set(t.piece.tolist())) == 4
