"""Secret scans with built-in functions only: fixed patterns, and character Markov models.

Two models of neighbouring characters are counted from labelled strings: values that the fixed patterns
find are random strings, ordinary words of a bounded sample of documents are identifiers. A long run
of key characters is a secret if its log-likelihood ratio passes a threshold.

Positions come from the lengths of what lies between matches, as running totals in blocks, so that the
work grows with the text. All patterns are read by Java, where ``(?i)`` concerns ASCII letters only.

Defined cases: a null text is an empty one; repeated rows and null ids give a row each; an empty table
gives an empty result; of the other columns only those asked for are kept. Spans of different kinds may overlap.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group that is measured, least length of that group. Fixed values.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KEY = "A-Za-z0-9+/_-"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: What counts as an ordinary word in training: letters in one case, parts joined by a line.
IDENTIFIER = "[A-Za-z][a-z]{5,}(?:[_-][a-z]+)*"
#: Row and column 0 stand for the start and for any other character.
STATES = len(ALPHABET) + 1
REDACTED = "[secret]"


class Models(NamedTuple):
    """log P(next | this) under random strings less that under identifiers, by this * STATES + next."""

    ratio: list[float]
    least_length: int
    threshold: float


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, start: Column) -> Column:
    """start + v1, start + v1 + v2, ... of a short array."""
    total = F.aggregate(values, F.array(start), lambda a, v: F.array_append(a, F.element_at(a, -1) + v))
    return F.slice(total, F.lit(2), F.size(values))


def summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def in_blocks(values: Column, block: int) -> Column:
    return F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / block).cast("int")),
                       lambda b: F.slice(values, b * block + 1, F.lit(block)))


def prefix_sums(values: Column, block: int = 256, levels: int = 2) -> Column:
    """Running totals of an array<bigint>, block by block, so that no long array is copied for each entry.

    What stands before each block is itself a running total of the blocks' sums, taken in the same way.
    """
    if not levels:
        return running(values, F.lit(0).cast("long"))

    def blocked(blocks: Column) -> Column:
        return let(F.transform(blocks, lambda x: summed(x)), lambda sums: F.flatten(F.zip_with(
            blocks, F.zip_with(prefix_sums(sums, block, levels - 1), sums, lambda t, s: t - s), running)))

    return F.when(F.size(values) <= block, running(values, F.lit(0).cast("long"))).otherwise(
        let(in_blocks(values, block), blocked))


SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"


def matches(text: Column, pattern: str, group: int, kind: str, rank: int, keep) -> Column:
    """The spans of a pattern's matches whose group passes ``keep``, in the order of the text."""
    lengths = lambda x: F.transform(x, lambda y: F.length(y).cast("long"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern)

    def placed(a: Column) -> Column:
        """a: the lengths of matches and gaps, and the values."""
        steps = F.zip_with(F.slice(a["gaps"], F.lit(1), F.size(a["sizes"])), a["sizes"], lambda g, s: g + s)
        ends = let(steps, lambda x: prefix_sums(x))
        spans = F.zip_with(F.arrays_zip(ends.alias("end"), a["sizes"].alias("size")), a["values"], lambda p, v: F.struct(
            (p["end"] - p["size"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            p["end"].alias("end"), v.alias("value")))
        return F.filter(spans, lambda s: keep(s["value"]))

    parts = F.struct(lengths(found).alias("sizes"), lengths(gaps).alias("gaps"), value.alias("values"))
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind as listed."""
    return F.array_sort(F.concat(*(
        matches(text, pattern, group, kind, rank, lambda v, least=least: F.length(v) >= least)
        for rank, (kind, pattern, group, least) in enumerate(BASE))))


def cells(value: Column) -> Column:
    """The model's cell for each pair of neighbouring characters of a string, its start included."""
    codes = F.transform(F.split(value, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))
    return let(F.slice(codes, F.lit(1), F.length(value)), lambda x: F.zip_with(
        F.concat(F.array(F.lit(0)), F.slice(x, F.lit(1), F.size(x) - 1)), x, lambda a, b: a * STATES + b))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000,
          least_length: int = 16, threshold: float = 10.0) -> Models:
    """Count both models.

    Random strings are the values that the fixed patterns find in all documents; identifiers are the
    ordinary words of at least six letters in ``sample`` documents, those with the smallest hash of their
    id. Only the counts of character pairs reach the driver, at most ``STATES`` squared for each model.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    secrets = (texts.filter(reduce(or_, (F.col("text").rlike(p) for _, p, _, _ in BASE)))
               .select(F.explode(base_spans(F.col("text"))).alias("span"))
               .select(F.lit(1).alias("secret"), F.explode(cells(F.col("span.value"))).alias("cell")))
    few = texts.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    bare = F.col("text")
    for _, pattern, _, _ in BASE:
        bare = F.regexp_replace(bare, pattern, " ")
    words = (texts.join(F.broadcast(few), "id")
             .select(F.explode(F.regexp_extract_all(bare, F.lit(IDENTIFIER), F.lit(0))).alias("word"))
             .select(F.lit(0).alias("secret"), F.explode(cells(F.col("word"))).alias("cell")))
    counts = {(r["secret"], r["cell"]): r["n"] for r in
              secrets.unionByName(words).groupBy("secret", "cell").agg(F.count("*").alias("n")).collect()}
    single = [1 + sum(counts.get((0, t * STATES + c), 0) for t in range(STATES)) for c in range(STATES)]
    ratio = []
    for this in range(STATES):
        row = [[counts.get((s, this * STATES + c), 0) for c in range(STATES)] for s in (0, 1)]
        words_n, secrets_n = sum(row[0]), sum(row[1])
        for c in range(STATES):
            # A random string may be in any alphabet, so half its weight is spread evenly; an
            # identifier's rare pairs fall back on how often the character occurs at all.
            random = 0.5 / STATES + 0.5 * (row[1][c] + 1) / (secrets_n + STATES)
            word = (row[0][c] + 2 * single[c] / sum(single)) / (words_n + 2)
            ratio.append(round(math.log(random / word), 6))
    return Models(ratio, least_length, threshold)


def likelihood_ratio(value: Column, models: Models) -> Column:
    """How much likelier a string is as random characters than as an identifier: a natural logarithm."""
    table = F.split(F.lit(",".join(map(str, models.ratio))), ",").cast("array<double>")
    return F.aggregate(cells(value), F.lit(0.0), lambda a, c: a + F.element_at(table, c + 1))


def is_random(value: Column, models: Models) -> Column:
    return value.rlike("[A-Za-z]") & (likelihood_ratio(value, models) >= models.threshold)


def scan(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (spans of the fixed patterns) and spans (those and the models' ones, kind ``markov``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = matches(F.col("text"), f"[{KEY}]{{{models.least_length},}}", 0, "markov", len(BASE),
                   lambda v: is_random(v, models))
    return (docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
            .select("doc_id", base_spans(F.col("text")).alias("base"), runs.alias("found"))
            .select("doc_id", "base", F.array_sort(F.concat("base", "found")).alias("spans")))


def written_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, models: Models) -> Column:
    """``text`` with every secret replaced, one kind after another; null stays null."""

    def without(value: Column, pattern: str, group: int, keep) -> Column:
        def replaced(v: Column) -> Column:
            found = F.regexp_extract_all(v, F.lit(pattern), F.lit(0))
            measured = F.regexp_extract_all(v, F.lit(pattern), F.lit(group))
            new = F.zip_with(found, measured, lambda f, m: F.when(keep(m), F.lit(REDACTED)).otherwise(f))
            parts = F.zip_with(F.split(v, pattern), new, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
            return F.when(v.rlike(pattern), F.array_join(parts, "")).otherwise(v)

        return let(value, replaced)

    for _, pattern, group, least in BASE:
        text = without(text, pattern, group, lambda v, least=least: F.length(v) >= least)
    return without(text, f"[{KEY}]{{{models.least_length},}}", 0, lambda v: is_random(v, models))
