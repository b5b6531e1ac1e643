"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else counts as one blank, and runs of one to three characters are
hashed to ``2 ** BITS`` columns. Document frequencies cover all training documents; the weights are fitted on
a bounded sample per language by follow-the-regularised-leader with an elastic net, and one
temperature, fitted on documents kept out of it, turns scores into calibrated probabilities.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text if no label
was learned; ties go to the first language in order; rows without id are never learned from; repeated rows
and empty tables give as many rows as they have; the result is one struct column, so others pass through.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilark.llm.common import Batches, fold, sliced

BITS = 15
UNKNOWN = "und"
COLUMN = "language"


class Grams:
    """Counts of hashed character n-grams of one text after another."""

    def __init__(self, bits: int = BITS, longest: int = 3):
        self.letters = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)
        self.bits, self.longest = bits, longest

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The columns that occur, and how often; none if the text has no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        real = self.letters[np.minimum(codes, 0xFFFF)]
        if len(codes) and codes.max() > 0xFFFF:
            high = np.flatnonzero(codes > 0xFFFF)
            kinds, which = np.unique(codes[high], return_inverse=True)
            real[high] = np.array([chr(c).isalpha() for c in kinds.tolist()])[which]
        if not real.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = np.where(real, codes, 32)
        codes = codes[real | np.concatenate([[True], real[:-1]])].astype(np.uint64)
        codes = np.concatenate([[32], codes, [32]]).astype(np.uint64) + np.uint64(1)
        keys, found = np.zeros(len(codes), np.uint64), []
        for n in range(1, self.longest + 1):
            if len(codes) < n:
                break
            keys = (keys[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
            found.append((keys >> np.uint64(64 - self.bits)).astype(np.int64))
        counts = np.bincount(np.concatenate(found), minlength=1 << self.bits)
        columns = np.flatnonzero(counts)
        return columns, counts[columns]


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # columns x languages
    bias: np.ndarray
    temperature: float


def vector(columns: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length."""
    values = (1 + np.log(counts)) * idf[columns]
    return values / max(np.sqrt((values * values).sum()), 1e-12)


def probabilities(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many texts each column occurs, and the number of texts with a letter: counted over all rows."""

    def run(batches: Batches) -> Batches:
        grams, seen, total = Grams(bits), np.zeros((1 << bits) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                columns, _ = grams(text or "")
                seen[columns] += 1
                total += len(columns) > 0
        seen[-1] = total
        place = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(seen[place])], names=["column", "n"])

    counted = texts.mapInArrow(run, "column long, n long").groupBy("column").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((1 << bits) + 1, np.int64)
    for r in counted:  # at most one row per column
        out[r["column"]] = r["n"]
    return out[:-1], int(out[-1])


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], width: int, kinds: int, epochs: int = 4, alpha: float = 1.0,
                      beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with per-coordinate rates; L1 keeps them sparse, L2 small."""
    z, n = np.zeros((width + 1, kinds)), np.zeros((width + 1, kinds))
    penalty = np.concatenate([np.full(width, l1), [0.0]])[:, None]

    def weights(at: np.ndarray) -> np.ndarray:
        short = np.abs(z[at]) <= penalty[at]
        return np.where(short, 0.0, -(z[at] - np.sign(z[at]) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            columns, values, kind = rows[i]
            at, x = np.append(columns, width), np.append(values, 1.0)
            w = weights(at)
            gap = probabilities(x @ w)
            gap[kind] -= 1
            slope = x[:, None] * gap[None, :]
            z[at] += slope - (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / alpha * w
            n[at] += slope * slope
    found = weights(np.arange(width + 1))
    return found[:-1].astype(np.float32), found[-1].astype(np.float32)


def best_temperature(scores: np.ndarray, kinds: np.ndarray) -> float:
    """The temperature under which held-out labels are likeliest, on a fine grid."""
    if not len(kinds):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(probabilities(scores / t)[np.arange(len(kinds)), kinds], 1e-12)).mean()

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", held_out: int = 0,
          per_language: int = 500, bits: int = BITS) -> Model:
    """Learn from the rows whose id is not in fold ``held_out`` of 5.

    Every label is learned, from at most ``per_language`` documents, those with the smallest hash of their id (which is looked for
    among about twice as many; counts of n-grams, not texts, reach the driver); a fifth of them sets the temperature. Rows that
    repeat an id count by their texts, a text once. The driver's memory grows with the labels, as the weights do.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    rows = rows.filter(fold("id") != held_out).filter("label is not null and text is not null")
    seen, total = document_frequencies(rows.select("text"), bits)
    idf = np.log((1 + total) / (1 + seen)) + 1
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    key = ["id", "label", "digest"]
    # Twice as many as wanted are below the cut on average, so the ranking never meets a language's every row.
    span = 1 << 40
    below = F.lit(2.0 * per_language * span) / F.col("n")
    nth = F.row_number().over(Window.partitionBy("label").orderBy("hash", "id", "digest"))
    few = (rows.select(*key, F.pmod(F.xxhash64("id"), F.lit(span)).alias("hash"))
           .join(F.broadcast(sizes), "label").filter(F.col("hash") < below).dropDuplicates(key).withColumn("nth", nth)
           .filter(F.col("nth") <= per_language).select(*key))

    def count(batches: Batches) -> Batches:
        grams = Grams(bits)
        for batch in batches:
            found = [grams(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("part"),
                 pa.array([a.astype(np.uint32).tobytes() for a, _ in found], pa.binary()),
                 pa.array([b.astype(np.uint32).tobytes() for _, b in found], pa.binary())],
                names=["label", "part", "columns", "counts"])

    # Broadcast: a row per label, and ``per_language`` of each, where the model has 2**bits numbers for each.
    picked = (rows.join(F.broadcast(few), key).dropDuplicates(key).select("label", "text", F.pmod(F.xxhash64("id"), F.lit(5)).alias("part"))
              .mapInArrow(count, "label string, part long, columns binary, counts binary").collect())
    picked = sorted(tuple(map(bytes, r[2:])) + (r[0], r[1]) for r in picked if r["columns"])
    names = sorted({r[2] for r in picked})
    data = []
    for columns, counts, label, part in picked:
        at = np.frombuffer(columns, np.uint32).astype(np.int64)
        data.append((at, vector(at, np.frombuffer(counts, np.uint32), idf), names.index(label), part))
    weights, bias = follow_the_leader([r[:3] for r in data if r[3]], 1 << bits, max(1, len(names)))
    kept = [r for r in data if not r[3]]
    scores = np.array([x @ weights[at] + bias for at, x, _, _ in kept]).reshape(-1, max(1, len(names)))
    return Model(names, idf, weights, bias, best_temperature(scores, np.array([r[2] for r in kept], int)))


def identify(docs: DataFrame, model: Model, text_col: str = "text", column: str = COLUMN) -> DataFrame:
    """``docs`` with a struct of pred and score (the calibrated probability of pred), from the whole text."""
    names = [n for n in docs.columns if n != column]
    kind = T.StructType([T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())])
    bits = len(model.idf).bit_length() - 1

    def run(batches: Batches) -> Batches:
        grams = Grams(bits)
        for batch in batches:
            for part in sliced(batch, text_col):
                pred, score = [], []
                for text in part.column(text_col).to_pylist():
                    columns, counts = grams(text or "")
                    if not len(columns) or not model.languages:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    raw = vector(columns, counts, model.idf) @ model.weights[columns] + model.bias
                    found = probabilities(raw.astype(float) / model.temperature)
                    pred.append(model.languages[int(found.argmax())])
                    score.append(float(found.max()))
                struct = pa.StructArray.from_arrays(
                    [pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["pred", "score"])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), struct], names=[*names, column])

    fields = [f for f in docs.schema.fields if f.name != column]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(column, kind)]))


def is_held_out(id_col: str = "doc_id", held_out: int = 0) -> Column:
    return F.coalesce(fold(id_col) == held_out, F.lit(True))
