"""Quality rules: text statistics, and a decision list learned from labelled rows by sequential covering.

Rules are conjunctions of thresholds on ratios of the statistics. Each rule is grown condition by
condition on two thirds of the labelled rows not covered yet, pruned on the rest, and kept if it is
precise enough there. The list becomes one ordered Spark conditional expression.

Defined cases: a null or empty text has statistics of 0 and fails the base rule; ratios with an empty
denominator are 0; without labelled rows of both kinds the list is empty and keeps everything; repeated
rows and null ids give a row each; an empty table gives an empty result. The statistics come as one
struct column, so columns of other names pass through.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilark.llm.common import Batches, sliced

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
              "n_digits", "n_marks", "n_distinct")
BLANK = " \t\n\v\f\r"
#: Characters that are counted, as RE2 classes.
CLASSES = {"n_symbols": "[#*$%&|<>]", "n_upper": r"\p{Lu}", "n_digits": "[0-9]", "n_marks": "[!?]"}
COLUMN = "text_statistics"


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a window of three words which occurs at least twice."""
    if len(codes) < 4:
        return 0
    # Numbers below the count of words, so that a pair and a window are numbers as well.
    codes = np.unique(codes, return_inverse=True)[1]
    pairs = np.unique(codes[:-1] * len(codes) + codes[1:], return_inverse=True)[1]
    inverse, counts = np.unique(pairs[:-1] * len(codes) + codes[2:], return_inverse=True, return_counts=True)[1:]
    if len(counts) == len(inverse):
        return 0
    again = counts[inverse] > 1
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k:k + len(again)] |= again
    return int(covered.sum())


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of whole texts."""
    texts = pc.fill_null(texts, "")
    out = {k: pc.count_substring_regex(texts, v).to_numpy() for k, v in CLASSES.items()}
    out["word_chars"] = (pc.utf8_length(texts).to_numpy()
                         - pc.count_substring_regex(texts, r"[\x20\x09-\x0D]").to_numpy())
    words = pc.ascii_split_whitespace(texts)
    ends = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten()
    real = (pc.binary_length(flat).to_numpy() > 0)  # none before leading or after trailing white space
    ends = np.concatenate([[0], np.cumsum(real)])[ends - ends[0]]
    codes = flat.dictionary_encode().indices.to_numpy()[real]
    more = {k: np.zeros(len(texts), np.int64) for k in STATISTICS if k not in out}
    for i, text in enumerate(texts.to_pylist()):
        own = codes[ends[i]:ends[i + 1]]
        more["n_words"][i] = len(own)
        more["n_distinct"][i] = len(np.unique(own))
        more["n_repeat_words"][i] = repeated_words(own)
        seen: set[str] = set()
        for line in text.split("\n"):
            if line.strip(BLANK):
                more["n_lines"][i] += 1
                if line in seen:
                    more["n_dup_lines"][i] += 1
                seen.add(line)
    return out | more


def statistics(docs: DataFrame, text_col: str = "text", column: str = COLUMN) -> DataFrame:
    """``docs`` with a struct of the statistics."""
    names = [n for n in docs.columns if n != column]
    kind = T.StructType([T.StructField(k, T.LongType()) for k in STATISTICS])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in sliced(batch, text_col):
                found = measure(part.column(text_col))
                struct = pa.StructArray.from_arrays(
                    [pa.array(found[k], pa.int64()) for k in STATISTICS], names=list(STATISTICS))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), struct], names=[*names, column])

    fields = [f for f in docs.schema.fields if f.name != column]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(column, kind)]))


def features(column: str = COLUMN) -> dict[str, Column]:
    """The ratios that rules test."""
    c = {k: F.col(f"`{column}`.{k}").cast("double") for k in STATISTICS}

    def share(a: str, b: str) -> Column:
        return F.when(c[b] > 0, c[a] / c[b]).otherwise(0.0)

    return {
        "words": c["n_words"], "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "word_chars"), "upper": share("n_upper", "word_chars"),
        "digits": share("n_digits", "word_chars"), "marks": share("n_marks", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"),
        "distinct": share("n_distinct", "n_words"), "line_words": share("n_words", "n_lines"),
    }


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float


Rule = tuple[Condition, ...]


def covers(rule: Rule, rows: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(rows.values()))), bool)
    for feature, above, threshold in rule:
        out &= rows[feature] > threshold if above else rows[feature] <= threshold
    return out


def grow(rows: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int = 32) -> Rule:
    """Add the condition with the largest information gain until no good row is covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for name, values in rows.items():
            own = np.unique(values[inside])
            if len(own) > cuts:
                own = np.unique(np.quantile(own, np.linspace(0, 1, cuts + 1)))
            for threshold in (own[:-1] + own[1:]) / 2:
                for above in (True, False):
                    hit = inside & (values > threshold if above else values <= threshold)
                    p, n = (hit & bad).sum(), (hit & ~bad).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(name, above, float(threshold)), g
        if best is None:
            break
        rule += (best,)
        inside &= covers((best,), rows)
    return rule


def prune(rule: Rule, rows: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that is worth most on rows it was not grown on."""
    def worth(k: int) -> float:
        hit = covers(rule[:k], rows)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[:max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7, rules: int = 24, conditions: int = 4,
          precision: float = 0.95, least: int = 5) -> list[Rule]:
    """The ordered rules that reject; ``precision`` and ``least`` rows are asked for on the pruning third."""
    out: list[Rule] = []
    names = list(rows)
    data, bad = np.array([rows[n] for n in names]), bad.astype(bool)
    rng = np.random.default_rng(seed)
    while len(out) < rules and bad.sum() >= 3 * least and (~bad).any():
        third = rng.permutation(len(bad)) % 3 == 0
        part = lambda mask: {n: data[i, mask] for i, n in enumerate(names)}
        rule = grow(part(~third), bad[~third], conditions)
        if not rule:
            break
        rule = prune(rule, part(third), bad[third])
        hit = covers(rule, part(third))
        right = (hit & bad[third]).sum()
        if right < least or right < precision * hit.sum():
            break
        out.append(rule)
        left = ~covers(rule, part(np.ones(len(bad), bool)))
        data, bad = data[:, left], bad[left]
    return out


def labelled(docs: DataFrame, labels: DataFrame, most: int = 20_000, id_col: str = "doc_id",
             label_col: str = "quality", text_col: str = "text") -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and badness (quality 0) of at most ``most`` labelled ids, those with the smallest hash.

    Only these rows reach the driver: a classifier may be fitted on a bounded sample.
    """
    few = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("label"))
           .orderBy(F.xxhash64("label_id"), "label_id").limit(most))
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    found = statistics(texts.join(F.broadcast(few), "label_id"), "text")
    picked = found.select("label_id", "label", *(c.alias(n) for n, c in features().items())).collect()
    picked.sort(key=lambda r: tuple(r))
    names = list(features())
    values = np.array([[r[n] for n in names] for r in picked], float).reshape(-1, len(names))
    return dict(zip(names, values.T)), np.array([r["label"] == 0 for r in picked], bool)


def base_failed(column: str = COLUMN, least_words: int = 50, percent: int = 50) -> Column:
    words, repeats = F.col(f"`{column}`.n_words"), F.col(f"`{column}`.n_repeat_words")
    return (words < least_words) | (100 * repeats > percent * words)


def verdict(rules: list[Rule], column: str = COLUMN) -> Column:
    """True for rows to keep: the first rule that holds rejects, and the last word is to keep."""
    ratio = features(column)
    out = None
    for rule in rules:
        test = F.lit(True)
        for feature, above, threshold in rule:
            test &= ratio[feature] > threshold if above else ratio[feature] <= threshold
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text", column: str = COLUMN) -> DataFrame:
    """``docs`` with the statistics, base_failed and kept."""
    return (statistics(docs, text_col, column).withColumn("base_failed", base_failed(column))
            .withColumn("kept", ~F.col("base_failed") & verdict(rules, column)))
