"""Phrase collocations by Rabin-Karp fingerprints.

A batch's words get 64-bit hashes h; prefix polynomials P[i] = h[0] + h[1]*B + ... + h[i-1]*B**(i-1), modulo
2**64 in numpy, give the hash of every n-gram as (P[i+k] - P[i]) / B**i. With language and length mixed in it
is a fingerprint. A shuffle sums fingerprints, each with a pointer to an occurrence; phrases as text exist
only for fingerprints that are frequent:

1. Words and pairs are counted by fingerprint.
2. Longer phrases are counted where each pair of words inside is frequent.
3. Frequent fingerprints are materialised: the text that holds the pointer's occurrence gives the phrase.
4. Every occurrence of a frequent fingerprint is verified, word by word, against that phrase. Occurrences of
   another phrase (a collision) are taken off the count and counted by their own text.

A colliding fingerprint can only be counted too high before step 4, so nothing is lost and the counts are
exact. Frequent pairs travel to step 2 as a Bloom filter of ``filter_bits`` bits, whatever the size of the corpus;
too many pairs for it only let more phrases through to the shuffle. Steps 3 and 4 broadcast the frequent
fingerprints if they are at most ``most``. With more, every task sends the phrases of what passes a Bloom filter, each
verified inside its batch, and the shuffle sums them by their text.

Defined cases: a null text is an empty one, a null language is ``und``; repeated rows and null ids count as rows;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilark.llm.common import Batches, sliced, written
from vigilark.llm.shingles import FACTOR, mix

#: Longest phrase in words.
WORDS = 5
#: Longest phrase that is counted without looking at its pairs.
SHORT = 2
#: 1 for what stands between words, 2 for what ends a piece, by byte. Fixed values.
BETWEEN, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x2545F4914F6CDD1D
UNKNOWN = "und"
#: Bytes of text that a task works on at once; each takes about 20 bytes of working memory.
SLICE_BYTES = 4 << 20


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    kinds, lower = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    kinds[list(BETWEEN)], kinds[list(ENDS)] = 1, 2
    lower[ord("A"):ord("Z") + 1] += 32
    return kinds, lower


KINDS, LOWER = _byte_tables()


class Tokens(NamedTuple):
    """The words of some texts: codes into a dictionary, their row, piece and place in the row."""

    codes: np.ndarray
    dictionary: pa.Array
    row: np.ndarray
    piece: np.ndarray
    place: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    """Words of whole texts, lower-cased in A-Z; words of one number ``piece`` stand in one piece."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if offsets[0] == offsets[-1]:
        none = np.zeros(0, np.int64)
        return Tokens(none, pa.array([], pa.large_binary()), none, none, none)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    kind = KINDS[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    inside = kind == 0
    starts = np.flatnonzero(inside & (fresh[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (fresh[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    piece = np.cumsum((kind == 2) | fresh[:-1])[starts]
    row = np.searchsorted(offsets, starts, side="right") - 1
    held = LOWER[data[inside]]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)])), pa.py_buffer(held)]).dictionary_encode()
    first = np.searchsorted(row, np.arange(len(texts)))
    return Tokens(words.indices.to_numpy().astype(np.int64), words.dictionary, row, piece, np.arange(len(row)) - first[row])


class Polynomials:
    """Hashes of all n-grams of a run of words."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        powers = np.multiply.accumulate(np.concatenate([[1], np.full(max(n - 1, 0), BASE)]).astype(np.uint64))[:n]
        inverse = pow(BASE, -1, 2 ** 64)
        self.inverses = np.multiply.accumulate(np.concatenate([[1], np.full(max(n - 1, 0), inverse)]).astype(np.uint64))[:n]
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)])

    def __call__(self, k: int) -> np.ndarray:
        n = max(len(self.prefix) - k, 0)
        return (self.prefix[k:k + n] - self.prefix[:n]) * self.inverses[:n]


class Grams:
    """Fingerprints of the n-grams of a batch, and where they may start."""

    def __init__(self, part: pa.RecordBatch):
        self.words = tokens(part.column("text"))
        self.good: np.ndarray | None = None
        langs = part.column("lang").dictionary_encode()
        self.lang = langs.indices.to_numpy().astype(np.int64)[self.words.row]
        self.langs = langs.dictionary
        hashed = lambda values: np.fromiter(map(xxhash.xxh3_64_intdigest, values.to_pylist()), np.uint64, len(values))
        self.polynomials = Polynomials(hashed(self.words.dictionary)[self.words.codes])
        self.kind = mix(hashed(self.langs) + FACTOR)[self.lang]
        # A pointer names an occurrence: 40 bits of its text's hash, and 24 of its place among the text's words.
        text = hashed(pc.fill_null(part.column("text"), ""))
        self.pointers = ((text[self.words.row] >> np.uint64(24) << np.uint64(24))
                         | (self.words.place.astype(np.uint64) & np.uint64(2 ** 24 - 1))).view(np.int64)

    def fingerprints(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprint of the n-gram at each word, and whether it stays inside a piece.

        The lowest bit tells short from long ones, which are counted apart.
        """
        found = self.polynomials(k)
        n, piece = len(found), self.words.piece
        prints = mix(found * FACTOR + self.kind[:n] + np.uint64(k)) << np.uint64(1) | np.uint64(k > SHORT)
        return prints, piece[:n] == piece[k - 1:k - 1 + n]

    def counted(self, k: int, pairs: Bloom | None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of the n-grams that count: long ones only where ``pairs`` holds every pair of words."""
        prints, inside = self.fingerprints(k)
        if k > SHORT:
            if self.good is None:
                two, within = self.fingerprints(2)
                self.good = pairs.holds(two) & within
            for j in range(k - 1):
                inside = inside & self.good[j:j + len(inside)]
        at = np.flatnonzero(inside)
        return at, prints[at]


class Bloom:
    """A set of fingerprints in a fixed number of bits; two of them for each."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def of(fingerprints: DataFrame, bits: int) -> Bloom:
        """Bits are combined in Spark; at most ``bits`` / 64 rows reach the driver."""
        places = F.array(*(F.shiftrightunsigned("fingerprint", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 32)))
        found = fingerprints.select(F.explode(places).alias("place")).groupBy(
            F.shiftright("place", 6).cast("int").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[found.column("word").to_numpy()] = found.column("mask").to_numpy()
        return Bloom(bits, words.view(np.uint64))

    def holds(self, fingerprints: np.ndarray) -> np.ndarray:
        out = np.ones(len(fingerprints), bool)
        for shift in (0, 32):
            place = (fingerprints >> np.uint64(shift)) & np.uint64(self.bits - 1)
            out &= (self.words[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _frequent(texts: DataFrame, lengths: range, least: int, pairs: Bloom | None) -> DataFrame:
    """fingerprint, n, pointer of the n-grams of these lengths that may be frequent."""
    shared = texts.sparkSession.sparkContext.broadcast(pairs)

    def count(batches: Batches) -> Batches:
        for batch in batches:
            for part in sliced(batch, "text", SLICE_BYTES):
                grams = Grams(part)
                places, found = zip(*(grams.counted(k, shared.value) for k in lengths))
                prints, first, n = np.unique(np.concatenate(found), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "fingerprint": pa.array(prints.view(np.int64)), "n": pa.array(n.astype(np.int64)),
                    "pointer": pa.array(grams.pointers[np.concatenate(places)[first]])})

    counted = texts.mapInArrow(count, "fingerprint long, n long, pointer long")
    return counted.groupBy("fingerprint").agg(F.sum("n").alias("n"), F.min("pointer").alias("pointer")).filter(F.col("n") >= least)


def grouped(codes: list[np.ndarray], prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place and the size of each group of equal n-grams, given the columns of their codes.

    Groups are those of the fingerprints; n-grams that differ from the first of their group are grouped by their codes.
    """
    _, first, group, sizes = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    other = np.zeros(len(prints), bool)
    for column in codes:
        other |= column != column[first][group]
    if other.any():
        at = np.flatnonzero(other)
        sizes = sizes - np.bincount(group[at], minlength=len(sizes))
        _, more, extra = np.unique(np.column_stack([c[at] for c in codes]), axis=0, return_index=True, return_counts=True)
        first, sizes = np.concatenate([first, at[more]]), np.concatenate([sizes, extra])
    return first, sizes


class Known(NamedTuple):
    """Frequent fingerprints in order, and a value for each."""

    prints: np.ndarray
    values: np.ndarray

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``prints`` are known, and their places here."""
        place = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        hit = np.flatnonzero(self.prints[place] == prints)
        return hit, place[hit]


def _phrase_texts(grams: Grams, starts: np.ndarray, k: int) -> tuple[pa.Array, pa.Array]:
    """Language and phrase of the n-grams at ``starts``."""
    words = [grams.words.dictionary.take(pa.array(grams.words.codes[starts + j])) for j in range(k)]
    phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if k > 1 else words[0]
    return grams.langs.take(pa.array(grams.lang[starts])), phrase.cast(pa.large_string()).cast(pa.string())


def _materialised(texts: DataFrame, frequent: DataFrame, pairs: Bloom) -> DataFrame:
    """``frequent`` with the language and phrase at each pointer; a task sends a phrase once, however many copies it has."""
    held = frequent.select("fingerprint", "pointer").toArrow()
    prints, pointers = (held.column(c).to_numpy() for c in ("fingerprint", "pointer"))
    order = np.argsort(prints.view(np.uint64))
    shared = texts.sparkSession.sparkContext.broadcast((Known(prints.view(np.uint64)[order], pointers[order]), pairs))

    def read(batches: Batches) -> Batches:
        known, pairs = shared.value
        sent = np.zeros(len(known.prints), bool)
        for batch in batches:
            for part in sliced(batch, "text", SLICE_BYTES):
                grams = Grams(part)
                for k in range(1, WORDS + 1):
                    at, prints = grams.counted(k, pairs)
                    hit, place = known.find(prints)
                    at = at[hit]
                    here = np.flatnonzero((grams.pointers[at] == known.values[place]) & ~sent[place])
                    if len(here):
                        place, first = np.unique(place[here], return_index=True)
                        sent[place] = True
                        lang, phrase = _phrase_texts(grams, at[here[first]], k)
                        yield pa.RecordBatch.from_arrays([pa.array(known.prints[place].view(np.int64)), lang, phrase],
                                                         names=["fingerprint", "lang", "phrase"])

    found = texts.mapInArrow(read, "fingerprint long, lang string, phrase string")
    one = found.groupBy("fingerprint").agg(F.min(F.struct("lang", "phrase")).alias("one"))
    return frequent.join(one, "fingerprint").select("fingerprint", "n", "pointer", "one.lang", "one.phrase")


class Spelt(NamedTuple):
    """Phrases as numbers: their words' places in a dictionary, -1 behind the last one."""

    known: Known
    words: pa.Array
    langs: pa.Array
    lang: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Spelt:
        prints = rows.column("fingerprint").to_numpy().view(np.uint64)
        order = np.argsort(prints)
        rows = rows.take(pa.array(order))
        split = pc.split_pattern(rows.column("phrase").combine_chunks().cast(pa.large_string()), " ")
        split = pa.concat_arrays(split.chunks) if isinstance(split, pa.ChunkedArray) else split
        words = split.flatten().dictionary_encode()
        sizes = np.diff(split.offsets.to_numpy())
        codes = np.full((len(order), WORDS), -1, np.int32)
        codes[np.arange(WORDS)[None, :] < sizes[:, None]] = words.indices.to_numpy()
        langs = rows.column("lang").combine_chunks()
        langs = (pa.concat_arrays(langs.chunks) if isinstance(langs, pa.ChunkedArray) else langs).dictionary_encode()
        return Spelt(Known(prints[order], codes), words.dictionary.cast(pa.large_binary()), langs.dictionary, langs.indices.to_numpy())


def _deviations(texts: DataFrame, spelt: Spelt, pairs: Bloom) -> DataFrame:
    """fingerprint, lang, phrase, n of occurrences that are not what their fingerprint stands for.

    A row without fingerprint and phrase has the number of all words of a language.
    """
    shared = texts.sparkSession.sparkContext.broadcast((spelt, pairs))
    schema = "fingerprint long, lang string, phrase string, n long"

    def verify(batches: Batches) -> Batches:
        (spelt, pairs), totals = shared.value, {}
        for batch in batches:
            for part in sliced(batch, "text", SLICE_BYTES):
                grams = Grams(part)
                for lang, n in zip(grams.langs.to_pylist(), np.bincount(grams.lang, minlength=len(grams.langs)).tolist()):
                    totals[lang] = totals.get(lang, 0) + n
                numbers = lambda own, all_: pc.index_in(own, all_).fill_null(-2).to_numpy()
                word = numbers(grams.words.dictionary, spelt.words)[grams.words.codes]
                lang = numbers(grams.langs, spelt.langs)[grams.lang]
                for k in range(1, WORDS + 1):
                    at, prints = grams.counted(k, pairs)
                    hit, place = spelt.known.find(prints)
                    at, prints = at[hit], prints[hit]
                    same = lang[at] == spelt.lang[place]
                    for j in range(WORDS):
                        same &= spelt.known.values[place, j] == (word[at + j] if j < k else -1)
                    if not same.all():
                        at, prints = at[~same], prints[~same]
                        first, sizes = grouped([grams.lang[at], *(grams.words.codes[at + j] for j in range(k))], prints)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(prints[first].view(np.int64)), *_phrase_texts(grams, at[first], k),
                            pa.array(sizes.astype(np.int64))], names=["fingerprint", "lang", "phrase", "n"])
        yield pa.RecordBatch.from_arrays([
            pa.nulls(len(totals), pa.int64()), pa.array(list(totals), pa.string()), pa.array([""] * len(totals), pa.string()),
            pa.array(list(totals.values()), pa.int64())], names=["fingerprint", "lang", "phrase", "n"])

    return texts.mapInArrow(verify, schema).groupBy("fingerprint", "lang", "phrase").agg(F.sum("n").alias("n"))


def _by_fingerprint(texts: DataFrame, frequent: DataFrame, pairs: Bloom) -> DataFrame:
    """lang, phrase, n, pointer: the frequent fingerprints' phrases, collisions taken apart; the empty phrase has all words."""
    named = written(_materialised(texts, frequent, pairs), "collocations-named")
    apart = written(_deviations(texts, Spelt.of(named.select("fingerprint", "lang", "phrase").toArrow()), pairs), "collocations-apart")
    off = apart.filter("fingerprint is not null").groupBy("fingerprint").agg(F.sum("n").alias("off"))
    kept = named.join(off, "fingerprint", "left").select("lang", "phrase", (F.col("n") - F.coalesce("off", F.lit(0))).alias("n"), "pointer")
    return kept.unionByName(apart.select("lang", "phrase", "n", F.lit(None).cast("long").alias("pointer")))


def _by_text(texts: DataFrame, frequent: Bloom, pairs: Bloom) -> DataFrame:
    """The same for any number of phrases: counts are summed by the phrases' text."""
    shared = texts.sparkSession.sparkContext.broadcast((frequent, pairs))

    def verify(batches: Batches) -> Batches:
        frequent, pairs = shared.value
        names = ["lang", "phrase", "n", "pointer"]
        for batch in batches:
            for part in sliced(batch, "text", SLICE_BYTES):
                grams = Grams(part)
                counts = np.bincount(grams.lang, minlength=len(grams.langs))
                yield pa.RecordBatch.from_arrays([
                    grams.langs, pa.array([""] * len(counts), pa.string()), pa.array(counts.astype(np.int64)),
                    pa.nulls(len(counts), pa.int64())], names=names)
                for k in range(1, WORDS + 1):
                    at, prints = grams.counted(k, pairs)
                    held = frequent.holds(prints)
                    at, prints = at[held], prints[held]
                    if len(at):
                        first, sizes = grouped([grams.lang[at], *(grams.words.codes[at + j] for j in range(k))], prints)
                        yield pa.RecordBatch.from_arrays([
                            *_phrase_texts(grams, at[first], k), pa.array(sizes.astype(np.int64)), pa.array(grams.pointers[at[first]])],
                            names=names)

    counted = texts.mapInArrow(verify, "lang string, phrase string, n long, pointer long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.min("pointer").alias("pointer"))


def phrases(docs: DataFrame, least: int = 100, text_col: str = "text", lang_col: str = "lang",
            filter_bits: int = 1 << 26, most: int = 1 << 20) -> DataFrame:
    """lang, phrase, n, pointer of all phrases of 1 to ``WORDS`` words with n >= least, and the empty phrase with all words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    short = written(_frequent(texts, range(1, SHORT + 1), least, None), "collocations-short")
    pairs = Bloom.of(short, filter_bits)
    long = written(_frequent(texts, range(SHORT + 1, WORDS + 1), least, pairs), "collocations-long")
    frequent = short.unionByName(long)
    few = 0 < frequent.count() <= most
    found = _by_fingerprint(texts, frequent, pairs) if few else _by_text(texts, Bloom.of(frequent, filter_bits), pairs)
    return written(found.filter((F.col("n") >= least) | (F.col("phrase") == "")), "collocations-phrases")


def _joined(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def scored(found: DataFrame, least: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase of two words or more: that of its lowest-scoring cut.

    score = floor(1000 * a * n / (l * r)) in whole numbers of 38 digits; ties go to the first cut.
    """
    totals = found.filter("phrase = ''").select("lang", F.col("n").alias("total"))
    counts = found.filter("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ", -1)
    cut = counts.filter((F.size(words) > 1) & (F.col("a") >= least)).withColumn("words", words).withColumn(
        "cut", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cut = cut.select("lang", "phrase", "a", "cut", _joined("words", F.lit(1), F.col("cut")).alias("left"),
                     _joined("words", F.col("cut") + 1, F.size("words") - F.col("cut")).alias("right"))
    side = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    whole = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(1000 * cast(a as decimal(17,0)) * cast(total as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = whole.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "total")).alias("best"))
    return best.select("lang", "phrase", "best.a", "best.l", "best.r", F.col("best.total").alias("n"), "best.score")


def standing(candidates: DataFrame, share: int = 100) -> DataFrame:
    """The candidates without those inside a longer one that is found at least ``share`` percent as often."""
    words = F.split("phrase", " ", -1)
    longer = candidates.select("lang", "a", words.alias("words")).filter(F.size("words") > 2)
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1))
    parts = longer.withColumn("k", F.explode(F.sequence(F.lit(2), F.size("words") - 1))).withColumn("at", starts)
    inside = parts.groupBy("lang", _joined("words", F.col("at"), F.col("k")).alias("phrase")).agg(F.max("a").alias("most"))
    digits = lambda name: F.col(name).cast("decimal(18,0)")
    return candidates.join(inside, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (100 * digits("most") < share * digits("a"))).drop("most")


def collocations(docs: DataFrame, least: int = 100, share: int = 100, top: int = 2000, **columns: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` highest-scoring phrases of each language."""
    candidates = standing(scored(phrases(docs, least, **columns), least), share)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return candidates.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
