import math
import random
import re
import resource
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from vigilark.llm import attention, common, lm
from vigilark.llm.subwords import WordEncoder

SETTINGS = lm.Settings(public_tokenizers.path("word_bpe_49k.json"), singles=40, symbols=64, documents=300, steps=150)


def words_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    out = [(i, t, 1) for i, t in enumerate([None, "", " \n", "One  one.", "é Ünï 😀", "x" * 3000, "a\x0bb\x0cc"])]
    for i in range(7, 400):
        # Every word is followed by one that begins with its last syllable.
        last, text = rng.choice(syllables), []
        for _ in range(rng.choice([2, 20, 100])):
            word = [last, *rng.choices(syllables, k=rng.randint(0, 2))]
            last = word[-1]
            text.append("".join(word))
        out.append((i, rng.choice([" ", "\n"]).join(text), 1))
    return out + [(None, "th er", 1), (20, out[20][1], 1), (20, out[20][1], 1)]


@pytest.fixture(scope="module")
def scored(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    return lm.score(docs, SETTINGS).collect()


def test_base_scores_are_exact(rows, scored):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t, _ in rows if not held(i) for w in words_of(t))
    total, below = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = sorted((str(i), held(i), len(words_of(t)), sum(counts[w] > 0 for w in words_of(t)), total,
                   round(sum(math.log10((counts[w] + 0.5) / below) for w in words_of(t)), 6)) for i, t, _ in rows)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)
    assert got == want


def test_model_beats_the_word_model_on_held_out_texts(scored):
    held = [r for r in scored if r.held_out and r.doc_id is not None and r.doc_id > 6]
    assert len(held) > 40
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in scored)


def test_symbols_and_pairs_come_from_all_documents(spark, rows, monkeypatch):
    models, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *given: models.append(fit(*given)) or models[-1])
    # The weights see few windows; what is counted must not hang on them.
    few = SETTINGS._replace(documents=2, windows=1, steps=2)
    lm.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), few)
    texts = [t for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    flat, ends = lm.sequences(WordEncoder(few.tokenizer), pa.array(texts, pa.string()), few.ids)
    n, symbol, k = np.bincount(flat, minlength=few.ids + 1), models[0].symbol, few.symbols
    assert set(np.flatnonzero(symbol == k - 2)) == set(np.flatnonzero(n == 0))
    n[few.ids] = 0
    assert sorted(n[symbol < few.singles]) == sorted(n)[-few.singles:]
    pairs, before = np.zeros((k + 1, k)), np.append(k, symbol[flat[:-1]])
    before[ends[:-1]] = k
    np.add.at(pairs, (before, symbol[flat]), 1)
    assert np.allclose(models[0].prior.pairs, attention.priors(pairs, models[0].shape).pairs)


def tiny():
    rng = np.random.default_rng(1)
    shape = attention.Shape(8, group=4, width=5, heads=2, key=3, value=4, hidden=6, context=4, stride=5)
    lengths = np.array([1, 0, 13, 5, 30])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return rng, shape, rng.integers(0, 8, ends[-1]), ends


def test_each_token_is_scored_once_and_probabilities_sum_to_one():
    rng, shape, sequence, ends = tiny()
    rows = attention.windows(*attention.window_places(ends, shape), ends, shape)
    places = rows[:, shape.context:]
    assert sorted(places[places >= 0].tolist()) == list(range(len(sequence)))
    p = {k: rng.normal(size=v.shape).astype(np.float32) * 0.3 for k, v in attention.start(shape, 0).items()}
    prior = attention.priors(rng.integers(0, 9, (9, 8)).astype(float), shape)
    known = rows >= 0
    seen, visible = lm.with_beginning(np.where(known, sequence[rows], 0), known, 8)
    hidden, last, _ = attention.forward(p, seen, visible, shape)
    total = sum(np.exp(attention.log_likelihood(p, prior, hidden, last, np.full(len(last), s), shape)) for s in range(8))
    assert np.allclose(total, 1, atol=1e-4)


def test_a_token_depends_on_nothing_after_it():
    rng, shape, sequence, ends = tiny()
    p = {k: rng.normal(size=v.shape).astype(np.float32) * 0.3 for k, v in attention.start(shape, 0).items()}
    rows = attention.windows(*attention.window_places(ends, shape), ends, shape)
    known = rows >= 0

    def hidden(seq):
        seen, visible = lm.with_beginning(np.where(known, seq[rows], 0), known, 8)
        return attention.forward(p, seen, visible, shape)[0].reshape(len(rows), shape.stride, -1)

    other = sequence.copy()
    other[25] = (other[25] + 1) % 8
    change = np.abs(hidden(sequence) - hidden(other)).max(axis=2) > 1e-6
    assert change.any() and (rows[:, shape.context:][change] > 25).all()


def test_gradients():
    rng, shape, sequence, ends = tiny()
    p = {k: rng.normal(size=v.shape) * 0.5 for k, v in attention.start(shape, 0).items()}
    rows = attention.windows(*attention.window_places(ends, shape), ends, shape)
    known = rows >= 0
    seen, visible = lm.with_beginning(np.where(known, sequence[rows], 0), known, 8)
    prior = attention.priors(rng.integers(0, 9, (9, 8)).astype(float), shape)
    real = known[:, shape.context:].ravel()
    target = np.where(real, seen[:, shape.context:].ravel(), 0)

    def loss():
        hidden, last, kept = attention.forward(p, seen, visible, shape, keep=True)
        return hidden, last, kept, -(attention.log_likelihood(p, prior, hidden, last, target, shape) * real).sum()

    hidden, last, kept, _ = loss()
    _, first, parts = attention.log_likelihood(p, prior, hidden, last, target, shape, slopes=True)
    slopes = attention.backward(p, shape, kept, first, parts, real.astype(float))
    for name, slope in slopes.items():
        for at in rng.integers(0, p[name].size, 6):
            at = np.unravel_index(at, p[name].shape)
            p[name][at] += 1e-2
            up = loss()[3]
            p[name][at] -= 2e-2
            down = loss()[3]
            p[name][at] += 1e-2
            assert abs((up - down) / 2e-2 - slope[at]) < 0.02 + 0.05 * abs(slope[at]), name


def test_sequences():
    encoder = WordEncoder(SETTINGS.tokenizer)
    flat, ends = lm.sequences(encoder, pa.array(["the the", "", None, "on"]), 7)
    the, on = encoder.texts(pa.array(["the", "on"]))[0].tolist()
    assert flat.tolist() == [the, the, 7, 7, 7, on, 7] and ends.tolist() == [0, 3, 4, 5, 7]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, SETTINGS).collect() == []


def plain_score(model, ids):
    """log10 P of one text, token by token and head by head, without windows as batches."""
    p, prior, shape = model.weights, model.prior, model.shape
    symbols, total = model.symbol[ids], 0.0
    for t, target in enumerate(symbols.tolist()):
        begin = t // shape.stride * shape.stride - shape.context
        places = [i for i in range(begin, t) if i >= -1]
        past = [shape.symbols if i < 0 else int(symbols[i]) for i in places]
        joined = [p["embed"][past[-1]]]
        for h in range(shape.heads):
            q = p["embed"][past[-1]] @ p["query"][h] / shape.key ** 0.5
            power = np.exp([q @ (p["embed"][s] @ p["keys"][h]) + p["bias"][h][t - 1 - i] for s, i in zip(past, places)])
            joined.append(power / power.sum() @ np.array([p["embed"][s] @ p["values"][h] for s in past]))
        hidden = np.maximum(np.concatenate(joined) @ p["inner"] + p["offset"], 0)
        group = target // shape.group
        first = np.exp(hidden @ p["first"] + prior.groups[past[-1]])
        block = slice(group * shape.group, (group + 1) * shape.group)
        inside = np.exp(hidden @ p["outer"][:, block] + prior.pairs[past[-1], block])
        total += np.log10(first[group] / first.sum()) + np.log10(inside[target % shape.group] / inside.sum()) + model.within[ids[t]]
    return total


def test_scores_equal_a_plain_model(spark, rows, monkeypatch):
    models, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *given: models.append(fit(*given)) or models[-1])
    some = SETTINGS._replace(steps=30)
    found = lm.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), some).collect()
    texts, encoder, checked = {i: t for i, t, _ in rows if i is not None}, WordEncoder(some.tokenizer), 0
    for r in found:
        if r.doc_id in texts and checked < 25:
            ids, _ = lm.sequences(encoder, pa.array([texts[r.doc_id]], pa.string()), some.ids)
            if len(ids) < 400:
                assert r.score == pytest.approx(plain_score(models[0], ids), rel=1e-4, abs=1e-3)
                checked += 1
    assert checked == 25


def test_weights_are_fitted_on_every_training_document(spark, rows, monkeypatch):
    models, fit = [], lm.fit
    monkeypatch.setattr(lm, "fit", lambda *given: models.append(fit(*given)) or models[-1])
    # The weights start from one window of two documents; every symbol that training texts hold must move all the same.
    few = SETTINGS._replace(documents=2, windows=1, steps=2)
    lm.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), few)
    texts = [t for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    flat, _ = lm.sequences(WordEncoder(few.tokenizer), pa.array(texts, pa.string()), few.ids)
    held = np.setdiff1d(models[0].symbol[flat], [few.symbols - 1])
    moved = (models[0].weights["embed"] != attention.start(models[0].shape, 3)["embed"]).any(axis=1)
    assert len(held) > 30 and moved[held].all()


def test_sums_by_number():
    rng = np.random.default_rng(2)
    which, change, want = rng.integers(0, 6, (4, 5)), rng.normal(size=(4, 5, 3)), np.zeros((8, 3))
    np.add.at(want, which.ravel(), change.reshape(-1, 3))
    assert np.allclose(attention.summed(which, change, 8), want)


def test_steps_use_memory_again():
    common.keep_freed()
    shape, rng = attention.Shape(512), np.random.default_rng(3)
    prior = attention.priors(rng.integers(0, 9, (513, 512)).astype(float), shape)
    adam = attention.Adam(attention.start(shape, 3), prior, shape)
    seen, known = rng.integers(0, 512, (lm.STEP, shape.span)), np.ones((lm.STEP, shape.span), bool)
    faults = []
    for _ in range(15):
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        adam.step(seen, known, 1e-3)
        faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
    assert sorted(faults)[7] < 100


def test_what_is_not_seen_has_no_part():
    rng, shape, sequence, ends = tiny()
    p = {k: rng.normal(size=v.shape) * 0.5 for k, v in attention.start(shape, 0).items()}
    rows = attention.windows(*attention.window_places(ends, shape), ends, shape)
    known, prior = rows >= 0, attention.priors(rng.integers(0, 9, (9, 8)).astype(float), shape)
    real = known[:, shape.context:].ravel()

    def slopes(fill):
        seen, visible = lm.with_beginning(np.where(known, sequence[rows], fill), known, 8)
        hidden, last, kept = attention.forward(p, seen, visible, shape, keep=True)
        target = np.where(real, seen[:, shape.context:].ravel(), 0)
        _, first, parts = attention.log_likelihood(p, prior, hidden, last, target, shape, slopes=True)
        return hidden[real], attention.backward(p, shape, kept, first, parts, real.astype(float))

    (one, some), (two, other) = slopes(0), slopes(5)
    assert np.allclose(one, two) and all(np.allclose(some[k], other[k]) for k in some)
    assert len(attention.tables(p, shape).heads[0][2]) == shape.symbols + 2
