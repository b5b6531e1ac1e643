import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vigilark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_and_places(spark):
    rng = random.Random(4)
    words = ["the", "thon,", "été.", "don't", "Σας", "12ab", "***", "<|endoftext|>", "İs", "a"]
    texts = [None, "", " \n", "one one", "one one"] + [
        " ".join(rng.choices(words, k=rng.choice([1, 5, 30, 200]))) for _ in range(150)]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(3, "one one", "x", 3), (None, "a b", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, rank long")
    got = packing.packed_documents(docs, PATH, capacity=64).collect()
    want = Counter()
    for doc, text, _, _ in rows:
        ids = ids_of(text)
        for k, start in enumerate(range(0, len(ids), 64)):
            piece = np.array(ids[start:start + 64], "<u4")
            want[doc, k, start, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(r.length for r in got) // 64)
    assert len(sequences) <= least + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed_documents(docs, PATH, capacity=64).collect() == []


def test_plan_covers_each_length_and_is_close_to_the_bound():
    rng = np.random.default_rng(2)
    for n, hot in ((1, 0), (50, 0), (2000, 900)):
        sizes = np.concatenate([np.clip(rng.lognormal(4, 1.2, n), 1, 512).astype(int), np.full(hot, 200)])
        histogram = {int(a): int(b) for a, b in zip(*np.unique(sizes, return_counts=True))}
        layout = packing.plan(histogram, 512, 100)
        held = Counter()
        for pattern, number in layout:
            assert sum(a * b for a, b in pattern.items()) <= 512
            for a, b in pattern.items():
                held[a] += b * number
        assert held == histogram
        fit = sum(k for _, k in packing.best_fit(np.array(list(histogram)), np.array(list(histogram.values())), 512))
        assert sum(k for _, k in layout) <= fit


def test_pricing_is_the_best_bounded_knapsack():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = np.unique(rng.integers(1, 12, 4))
        counts = rng.integers(1, 4, len(sizes))
        worth = rng.random(len(sizes))
        pattern = packing.best_pattern(sizes, counts, worth, 20)
        best = max((sum(worth * np.array(p)) for p in np.ndindex(*(counts + 1)) if (sizes * np.array(p)).sum() <= 20))
        assert (sizes * pattern).sum() <= 20 and (pattern <= counts).all()
        assert abs((worth * pattern).sum() - best) < 1e-9
