"""Language-model scores: a causal self-attention model on subword ids, and an exact word model beside it.

Texts are encoded once and written beside their ids. Counts come from all training documents: words, and pairs of
neighbouring subword ids, from which follow how often an id occurs, its symbol and the pairs of symbols. The attention
weights start from a few windows and then pass over every window of every training document once: each task goes
on from the common weights with its own rows, and after each of ``rounds`` shares of the documents the weights of all
tasks are averaged by their windows (local SGD). Frequent ids are symbols of their own; the others share
symbols by the company they keep, and within a symbol an id has its share of the counts. A text is
scored in overlapping windows, every token once, in batches of masked attention.

The word model's counts are joined by word, except those of words with at least 1 in ``HEAVY`` of all
tokens: there can be no more than ``HEAVY`` of these, so they are sent to every task.

Defined cases: a null text is an empty one, whose only token is its end; rows without id are scored but
never learned from and count as held out; repeated rows are scored each; without training documents all
ids are equally likely within their symbol; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm import attention
from vigilark.llm.common import Batches, fold, give_back, keep_freed, sliced, written
from vigilark.llm.shingles import FACTOR, mix
from vigilark.llm.subwords import WordEncoder

HEAVY = 1 << 19
#: Distinct words, or pairs of ids, that a task counts before it passes them on.
HELD = 50_000
#: Bytes of text that a task works on at once.
SLICE_BYTES = 2 << 20
#: Rows that Spark hands to a task at once: less than elsewhere, as three passes hold texts, ids and a model.
ROWS = 400
#: Distinct parts of words that a task's encoder keeps.
KNOWN_PARTS = 150_000
#: Windows of a step, and the longest step, in the pass over all training documents.
STEP, RATE = 96, 3e-3


class Settings(NamedTuple):
    tokenizer: str
    ids: int = 49_408  # of the tokenizer; one more is the end of a text
    singles: int = 440
    symbols: int = 512
    documents: int = 4000  # from whose windows the weights start
    windows: int = 6  # of each
    steps: int = 400  # of that start
    rounds: int = 4  # averages in the pass over all training documents
    folds: int = 5
    held_out: int = 1


class Model(NamedTuple):
    settings: Settings
    shape: attention.Shape
    weights: dict[str, np.ndarray]
    prior: attention.Priors
    symbol: np.ndarray  # of each id
    within: np.ndarray  # log10 P(id | symbol)


def sequences(encoder: WordEncoder, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with its end, and where each starts (with the end)."""
    return with_ends(*encoder.texts(texts), end)


def with_ends(ids: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    texts = len(ends) - 1
    out = np.full(len(ids) + texts, end, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(texts), np.diff(ends))] = ids
    return out, ends + np.arange(len(ends))


def _kind(settings: Settings) -> type:
    return np.uint16 if settings.ids < 1 << 16 else np.uint32


def encoded(texts: DataFrame, settings: Settings) -> DataFrame:
    """uid, doc_id, held_out, text, ids of the rows of ``texts`` (doc_id, held_out, text); a text's ids without its end."""
    def run(batches: Batches) -> Batches:
        keep_freed()
        encoder, task, kind = WordEncoder(settings.tokenizer, KNOWN_PARTS), TaskContext.get(), _kind(settings)
        uid = (task.partitionId() if task else 0) << 33
        for batch in batches:
            for part in sliced(batch, "text", SLICE_BYTES):
                flat, ends = encoder.texts(part.column("text"))
                ids = pa.Array.from_buffers(pa.binary(), part.num_rows, [
                    None, pa.py_buffer((ends * np.dtype(kind).itemsize).astype(np.int32)), pa.py_buffer(flat.astype(kind))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(part.num_rows)), *part.columns, ids], names=["uid", *part.schema.names, "ids"])
                uid += part.num_rows

    return texts.mapInArrow(lambda batches: give_back(run(batches)), "uid long, doc_id long, held_out boolean, text string, ids binary")


def ids_of(column: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, each with its end, and where each starts (with the end)."""
    kind = _kind(settings)
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return with_ends(flat.astype(np.int32), (ends - ends[0]) // np.dtype(kind).itemsize, settings.ids)


def corpus_counts(rows: DataFrame, settings: Settings) -> DataFrame:
    """word, cell, n over all rows (text, ids): words, lower-cased in A-Z, and pairs of neighbouring ids.

    A row has a word or a cell, first * (ids + 2) + second; a text's last id is its end, ``ids``, and the first
    of its first pair is its beginning, ``ids`` + 1. Tasks count before they pass rows on.
    """

    def run(batches: Batches) -> Batches:
        keep_freed()
        held: dict[str, list[pa.Table]] = {"word": [], "cell": []}

        def summed(name: str) -> pa.Table:
            return pa.concat_tables(held[name]).group_by(name).aggregate([("n", "sum")]).rename_columns([name, "n"])

        def rows(name: str) -> Batches:
            for batch in summed(name).combine_chunks().to_batches():
                found, size = batch.column(name), batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [found if name == "word" else pa.nulls(size, pa.string()),
                     found if name == "cell" else pa.nulls(size, pa.int64()), batch.column("n")], names=["word", "cell", "n"])
            held[name] = []

        for batch in batches:
            for part in sliced(batch, "text", SLICE_BYTES):
                words = pc.ascii_split_whitespace(pc.ascii_lower(part.column("text")))
                coded = words.flatten().dictionary_encode()
                found = pa.table({"word": coded.dictionary, "n": np.bincount(
                    coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)})
                held["word"].append(found.filter(pc.greater(pc.binary_length(found.column("word")), 0)))
                ids, ends = ids_of(part.column("ids"), settings)
                before = np.empty(len(ids), np.int64)
                before[1:] = ids[:-1]
                before[ends[:-1]] = settings.ids + 1
                cells, n = np.unique(before * (settings.ids + 2) + ids, return_counts=True)
                held["cell"].append(pa.table({"cell": cells, "n": n.astype(np.int64)}))
                for name in held:
                    if sum(len(t) for t in held[name]) > HELD:
                        held[name] = [summed(name)]
                        if len(held[name][0]) > HELD // 2:
                            yield from rows(name)
        for name in held:
            if held[name]:
                yield from rows(name)

    return rows.mapInArrow(lambda batches: give_back(run(batches)), "word string, cell long, n long").groupBy("word", "cell").agg(F.sum("n").alias("n"))


def sample(rows: DataFrame, settings: Settings, span: int, stride: int, context: int) -> list[np.ndarray]:
    """Windows of ids of ``documents`` rows of ``rows`` (uid, doc_id, ids), those with the smallest hash of their id.

    Which windows of a row are taken follows from a hash of its place and length, over its whole length. A window
    holds -1 where the text has no token.
    """
    shape = attention.Shape(settings.symbols, context=context, stride=stride)
    few = rows.select("doc_id", "uid").orderBy(F.xxhash64("doc_id"), "doc_id", "uid").limit(settings.documents)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in sliced(batch, "ids", SLICE_BYTES):
                flat, ends = ids_of(part.column("ids"), settings)
                text, nth = attention.window_places(ends, shape)
                sizes = np.diff(ends)[text]
                order = mix(mix(nth.astype(np.uint64) * FACTOR + sizes.astype(np.uint64)) + flat[ends[text]].astype(np.uint64))
                rank = np.lexsort((order, text))
                place = np.arange(len(text)) - np.searchsorted(text[rank], text[rank])
                some = np.sort(rank[place < settings.windows])
                found = attention.windows(text[some], nth[some], ends, shape)
                found = np.where(found >= 0, flat[found], -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in found], pa.binary())], names=["window"])

    # A row per document of the sample: its number is a setting.
    found = rows.select("uid", "ids").join(F.broadcast(few.select("uid")), "uid").select("ids").mapInArrow(run, "window binary").collect()
    return [np.frombuffer(x, np.int32) for x in sorted(bytes(r["window"]) for r in found)]


def id_counts(pairs: DataFrame, settings: Settings) -> np.ndarray:
    """How often each id occurs: every id is the second of one pair."""
    found = pairs.groupBy((F.col("cell") % (settings.ids + 2)).alias("id")).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(settings.ids + 1)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


def symbols_of(pairs: DataFrame, counts: np.ndarray, settings: Settings, rounds: int = 8) -> np.ndarray:
    """The symbol of each id: its own for the most frequent, else one shared with ids of like company.

    The last symbol is the end of a text, the one before it all ids that no training text holds.
    """
    ids = settings.ids + 1
    order = np.argsort(-counts, kind="stable")
    order = order[(counts[order] > 0) & (order != settings.ids)]
    own, rest = order[:settings.singles], order[settings.singles:]
    out = np.full(ids, settings.symbols - 2, np.int32)
    out[own] = np.arange(len(own))
    out[settings.ids] = settings.symbols - 1
    kinds = settings.symbols - 2 - settings.singles
    if len(rest) > kinds:
        company = companies(pairs, out, rest, settings)
        centres = company[:kinds].copy()
        for _ in range(rounds):
            nearest = (company @ centres.T).argmax(axis=1)
            np.add.at(centres, nearest, company)
            centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9
        out[rest] = settings.singles + nearest
    else:
        out[rest] = settings.singles + np.arange(len(rest))
    return out


def companies(pairs: DataFrame, symbol: np.ndarray, rest: np.ndarray, settings: Settings) -> np.ndarray:
    """A row of length 1 for each id of ``rest``: the ids with a symbol of their own that stand before and after it."""
    singles, width = settings.singles, 2 * settings.singles
    # One more place for the beginning of a text, which is no company.
    place = np.full(settings.ids + 2, -1)
    place[rest] = np.arange(len(rest))
    single = np.where(np.append(symbol, singles) < singles, np.append(symbol, singles), -1)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            first, second = np.divmod(batch.column("cell").to_numpy(), settings.ids + 2)
            n = batch.column("n").to_numpy()
            for a, b, shift in ((second, first, 0), (first, second, singles)):
                both = (place[a] >= 0) & (single[b] >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((place[a][both] * width + single[b][both] + shift).astype(np.int32)),
                     pa.array(np.log1p(n[both]).astype(np.float32))], names=["cell", "weight"])

    # A cell is one pair of ids, so it has one row.
    found = pairs.mapInArrow(run, "cell int, weight float").toArrow()
    out = np.zeros(len(rest) * width, np.float32)
    out[found.column("cell").to_numpy()] = found.column("weight").to_numpy()
    out = out.reshape(len(rest), width)
    out /= np.linalg.norm(out, axis=1, keepdims=True) + 1e-9
    return out


def symbol_pairs(pairs: DataFrame, symbol: np.ndarray, settings: Settings) -> np.ndarray:
    """Counts of neighbouring symbols, (symbols + 1) x symbols, the last row for the beginning of a text.

    Tasks sum into an array of fixed size; at most that many rows reach the driver.
    """
    k = settings.symbols
    own = np.append(symbol, k).astype(np.int64)

    def run(batches: Batches) -> Batches:
        out = np.zeros((k + 1) * k, np.int64)
        for batch in batches:
            first, second = np.divmod(batch.column("cell").to_numpy(), settings.ids + 2)
            np.add.at(out, own[first] * k + own[second], batch.column("n").to_numpy())
        place = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(out[place])], names=["cell", "n"])

    found = pairs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros((k + 1) * k)
    flat[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return flat.reshape(k + 1, k)


def fit(train: DataFrame, pairs: DataFrame, settings: Settings) -> Model:
    """The attention model for training rows (uid, doc_id, ids) whose pairs of ids are ``pairs`` (cell, n)."""
    shape = attention.Shape(settings.symbols)
    k = settings.symbols
    counts = id_counts(pairs, settings)
    symbol = symbols_of(pairs, counts, settings)
    prior = attention.priors(symbol_pairs(pairs, symbol, settings), shape)

    windows = sample(train, settings, shape.span, shape.stride, shape.context)
    windows = np.array(windows, np.int64).reshape(-1, shape.span)
    known = windows >= 0
    seen, visible = with_beginning(np.where(known, symbol[windows], 0), known, k)
    keep_freed()
    weights = attention.train(seen, visible, prior, shape, settings.steps)
    for nth in range(settings.rounds):
        share = train.filter(F.pmod(F.xxhash64("uid"), F.lit(settings.rounds)) == nth)
        weights = passed(share, weights, prior, symbol, shape, settings, RATE * (1 - 0.9 * nth / settings.rounds))
    share = counts + 0.01
    within = np.log10(share / np.bincount(symbol, weights=share, minlength=k)[symbol])
    return Model(settings, shape, weights, prior, symbol, within)


def passed(rows: DataFrame, weights: dict[str, np.ndarray], prior: attention.Priors, symbol: np.ndarray, shape: attention.Shape,
           settings: Settings, rate: float) -> dict[str, np.ndarray]:
    """The weights after one pass over every window of ``rows`` (ids): the mean of all tasks' by their windows.

    Windows of a slice are taken in a random order, as those of one text are alike. A task passes on as many rows as there are weights.
    """
    names, sizes = list(weights), [w.size for w in weights.values()]

    def run(batches: Batches) -> Batches:
        keep_freed()
        adam, rng, total = attention.Adam(weights, prior, shape), np.random.default_rng(3), 0
        for batch in batches:
            for part in sliced(batch, "ids", SLICE_BYTES):
                flat, ends = ids_of(part.column("ids"), settings)
                text, nth = attention.window_places(ends, shape)
                order, own = rng.permutation(len(text)), symbol[flat]
                for some in np.array_split(order, max(1, round(len(order) / STEP))):
                    found = attention.windows(text[some], nth[some], ends, shape)
                    known = found >= 0
                    adam.step(*with_beginning(np.where(known, own[found], 0), known, shape.symbols), rate)
                total += len(text)
        if total:
            flat = np.concatenate([adam.p[n].ravel() for n in names]).astype(np.float64) * total
            # The last cell is the number of windows.
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1, dtype=np.int32)), pa.array(np.append(flat, total))],
                                             names=["cell", "value"])

    found = rows.select("ids").mapInArrow(lambda batches: give_back(run(batches)), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    if not found.num_rows:
        return weights
    flat = np.zeros(sum(sizes) + 1)
    flat[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    parts = np.split(flat[:-1] / flat[-1], np.cumsum(sizes)[:-1])
    return {n: part.reshape(weights[n].shape).astype(np.float32) for n, part in zip(names, parts)}


def with_beginning(seen: np.ndarray, known: np.ndarray, beginning: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol ``beginning`` at the place before a text's first token; only that and tokens may be seen."""
    rows, at = np.nonzero(known[:, 1:] & ~known[:, :-1])
    seen, visible = seen.copy(), known.copy()
    seen[rows, at] = beginning
    visible[rows, at] = True
    return seen, visible


def text_scores(model: Model, flat: np.ndarray, ends: np.ndarray, batch: int = 256) -> np.ndarray:
    """log10 P of each text's ids, which lie one after another in ``flat``."""
    shape, symbol = model.shape, model.symbol[flat]
    text, nth = attention.window_places(ends, shape)
    ready = attention.prepared(model.weights, shape)
    out = np.zeros(len(text))
    for at in range(0, len(text), batch):
        part = attention.windows(text[at:at + batch], nth[at:at + batch], ends, shape)
        known = part >= 0
        seen, visible = with_beginning(np.where(known, symbol[part], 0), known, shape.symbols)
        hidden, last, _ = attention.forward(model.weights, seen, visible, shape, ready)
        real = known[:, shape.context:]
        target = np.where(real, seen[:, shape.context:], 0).ravel()
        found = attention.log_likelihood(model.weights, model.prior, hidden, last, target, shape)
        out[at:at + batch] = np.where(real, found.reshape(real.shape), 0).sum(axis=1, dtype=np.float64)
    places = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    return (np.bincount(text, weights=out, minlength=len(ends) - 1) / np.log(10)
            + np.bincount(places, weights=model.within[flat], minlength=len(ends) - 1))


def score(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = F.coalesce(fold("doc_id", settings.folds) == settings.held_out, F.lit(True))
    coded = written(encoded(texts.select("doc_id", held.alias("held_out"), "text"), settings), "encoded")
    train = coded.filter("not held_out")
    found = written(corpus_counts(train.select("text", "ids"), settings), "counts")
    counts, pairs = found.filter("word is not null").select("word", "n"), found.filter("word is null").select("cell", "n")
    documents = train.count()
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    # The end of a text is a token as well.
    total, distinct = (total or 0) + documents, distinct + (documents > 0)
    below = total + 0.5 * (distinct + 1)
    heavy = counts.filter(F.col("n") >= max(1.0, total / HEAVY)).toArrow()
    model = fit(train, pairs, settings)
    heavy_words = heavy.column("word").combine_chunks()
    heavy_logs = np.log10((heavy.column("n").to_numpy() + 0.5) / below)
    end_log, end_known = float(np.log10((documents + 0.5) / below)), int(documents > 0)

    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "n"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64()]

    def run(batches: Batches) -> Batches:
        keep_freed()
        for batch in batches:
            for part in sliced(batch, "text", SLICE_BYTES):
                rows, uid = part.num_rows, part.column("uid").to_numpy()
                words = pc.ascii_split_whitespace(pc.ascii_lower(part.column("text")))
                cuts = words.offsets.to_numpy().astype(np.int64)
                flat = words.flatten()
                coded = flat.dictionary_encode()
                ids = ids_of(part.column("ids"), settings)
                real = pc.binary_length(flat).to_numpy() > 0
                ends = np.concatenate([[0], np.cumsum(real)])[cuts - cuts[0]]
                text = np.repeat(np.arange(rows), np.diff(ends))
                code = coded.indices.to_numpy()[real]
                place = pc.index_in(coded.dictionary, value_set=heavy_words).fill_null(-1).to_numpy()[code]
                light = place < 0
                logs = heavy_logs[np.maximum(place, 0)] if len(heavy_logs) else np.zeros(len(place))
                base = np.bincount(text[~light], weights=logs[~light], minlength=rows) + end_log
                known = np.bincount(text[~light], minlength=rows) + end_known
                yield pa.RecordBatch.from_arrays([
                    part.column("uid"), part.column("doc_id"), part.column("held_out"),
                    pa.array(np.diff(ends) + 1), pa.array(known), pa.array(base),
                    pa.array(text_scores(model, *ids)),
                    pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64())], names=names)
                # A row for each other word of a text, to meet its count by a join.
                keys, n = np.unique(text[light] * len(coded.dictionary) + code[light], return_counts=True)
                size, none = len(coded.dictionary), [pa.nulls(len(keys), k) for k in kinds]
                none[0] = pa.array(uid[keys // max(1, size)])
                none[7], none[8] = coded.dictionary.take(pa.array(keys % max(1, size))), pa.array(n)
                yield pa.RecordBatch.from_arrays(none, names=names)

    made = written(coded.mapInArrow(
        lambda batches: give_back(run(batches)), "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word string, n long"), "scores")
    count = F.coalesce("count", F.lit(0))
    light = (made.filter("word is not null").select("uid", "word", "n")
             .join(counts.withColumnRenamed("n", "count"), "word", "left")
             .select("uid", F.when(count > 0, F.col("n")).otherwise(0).alias("n_known"),
                     (F.col("n") * F.log10((count + 0.5) / below)).alias("base")))
    rows = made.filter("word is null").drop("word", "n").unionByName(light, allowMissingColumns=True)
    return rows.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.max("score").alias("score")).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
