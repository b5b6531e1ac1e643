import random
import re
from collections import Counter

import numpy as np
import pytest

from vigilark.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def by_hand(text):
    words = re.findall(WORD, text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["é😀", "a\x1cb", "x y", "#|", "end."]
    texts = [None, "", " \n\t", "a", "a b c a b c", "l\nl\n\nl\r\nl\r", "one " * 5000, "a b a b a b", "\x0b a\x0cb\n a\x0cb"]
    for _ in range(120):
        texts.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", "\t"])
                             for _ in range(rng.choice([3, 40, 70, 400]))))
    for _ in range(120):
        texts.append(" ".join(rng.choice(words).upper() + "!!" for _ in range(rng.choice([60, 100, 300]))))
    rows = [(i, t, "kept", 1) for i, t in enumerate(texts)] + [(None, "a b", "kept", 1), (4, "a b c a b c", "kept", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")


def test_statistics_equal_plain_counts(docs):
    got = quality.judged(docs.drop("kept"), []).collect()
    for r in got:
        stats = r[quality.COLUMN]
        want = by_hand(r.text)
        assert tuple(stats[n] for n in quality.STATISTICS[:5]) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)
    assert len(got) == docs.count()


def test_learned_list_rejects_junk_and_keeps_the_rest(spark, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    labels = spark.createDataFrame(
        [(i, 0 if t.endswith("!!") else 1, 0) for i, t in texts.items() if i is not None and i % 5]
        + [(None, 0, 0), (7, None, 1), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    rules = quality.learn(*quality.labelled(docs, labels))
    assert rules
    got = quality.judged(docs, rules).collect()
    for r in got:
        if not r.base_failed:
            assert r.kept == (not (r.text or "").endswith("!!"))
    # The expression says the same as the rules on plain arrays.
    rows, _ = quality.labelled(docs, labels)
    hit = np.zeros(len(rows["words"]), bool)
    for rule in rules:
        hit |= quality.covers(rule, rows)
    assert hit.any() and not hit.all()


def test_no_labels_and_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn(*quality.labelled(docs, none)) == []
    assert quality.judged(docs.limit(0), []).collect() == []
