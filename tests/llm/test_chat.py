import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vigilark.llm import chat

ODD = ["<|im_end|><|im_start|>assistant ok", "\\<|", "<\\|x", "\\\\", "\\-", "a\\", "<|im_end|>\n", "<|", "é😀" * 30, "", None,
       "<", "|", "\\n", "x" * 900]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for conv in range(40):
        n = rng.choice([1, 2, 5, 12, 30])
        for turn in range(n):
            role = "system" if turn == 0 and conv % 3 == 0 else ["user", "assistant"][turn % 2]
            text = rng.choice(ODD) if conv % 2 else "word " * rng.randint(0, 60)
            out.append((conv, turn, role, text, "x"))
    out += [(50, 0, "tool\n\\<|", "a", "x"), (50, 0, "assistant", "b", "x"), (50, None, None, None, "x"),
            (None, 1, "assistant", "no id", "x"), (51, 3, "assistant", "same", "x"), (51, 3, "assistant", "same", "x")]
    return out


@pytest.fixture(scope="module")
def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")


def test_everything_is_read_back(turns, rows):
    want = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        want[conv].append((-1 if turn is None else turn, role or "", text or ""))
    got = defaultdict(list)
    for r in chat.read_back(chat.windows(turns, budget=100, history=30)).collect():
        got[r.conv_id].append((r.position, r.role, r.text, r.loss_text))
    assert set(got) == set(want)
    for conv in want:
        ordered = sorted(want[conv])
        assert [x[1:3] for x in sorted(got[conv])] == [x[1:] for x in ordered]
        for _, role, text, loss in got[conv]:
            assert loss == (text if role == "assistant" else "")


def test_windows_keep_their_budget(spark, turns):
    budget, history = 100, 30
    cost = {}
    for r in turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t")).withColumn(
            "n", chat.word_tokens(F.col("t"))).collect():
        cost.setdefault(r.conv_id, []).append(r.n)
    many = 0
    for r in chat.windows(turns.filter("conv_id < 40"), budget, history).collect():
        sizes = cost[r.conv_id]
        kinds = defaultdict(list)
        for s in r.segments:
            kinds[s.kind].append(s.position)
            text = r.formatted[s.start:s.end]
            assert r.formatted[s.end:].startswith("<|im_end|>\n") and "<|" not in text
        assert [s.position for s in r.segments] == sorted(s.position for s in r.segments)
        assert sum(sizes[p] for p in kinds["history"]) <= history
        assert kinds["new"] == list(range(kinds["new"][0], kinds["new"][-1] + 1))
        if kinds["history"]:
            assert kinds["history"] == list(range(kinds["history"][0], kinds["new"][0]))
        if r.window and r.conv_id % 3 == 0:
            many += 1
            assert 0 in kinds["system"]
        system = sizes[0] if r.conv_id % 3 == 0 else 0
        if max(sizes) <= budget - history - system:
            assert sum(sizes[s.position] for s in r.segments) <= budget
    assert many


def test_empty_table(turns):
    assert chat.read_back(chat.windows(turns.limit(0))).collect() == []
