"""Keyword retrieval by TF-IDF, retrieval metrics and the embedding column."""

from __future__ import annotations

import ctypes
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vigilark import dims
from vigilark.functions.text import truncate_at_sentence, with_bigrams, words
from vigilark.session import checkpoint, written


def term_counts(texts: DataFrame, id_column: str, text_column: str = "text",
                stop_words: list[str] | None = None) -> DataFrame:
    """(id, term, tf) over words and neighbouring pairs.

    Texts are spread by id first: counting, the norm and the scores are then
    all local to that partitioning.
    """
    stop = dims.STOP_WORDS if stop_words is None else stop_words
    tokens = texts.select(id_column, words(text_column, stop).alias("_tokens"))
    terms = tokens.repartition(id_column).select(
        id_column, F.explode(with_bigrams(F.col("_tokens"))).alias("term"))
    return terms.groupBy(id_column, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_documents: Column, size: int | None = None) -> DataFrame:
    """All terms, or the ``size`` most frequent ones, with ``idf = ln((1 + n) / (1 + df)) + 1``."""
    terms = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    if size is not None:
        terms = terms.orderBy(F.desc("cf"), "term").limit(size)
    return (
        terms.withColumn("idf", F.log((1 + n_documents) / (1 + F.col("df"))) + 1)
        .select("term", "idf", "df")
    )


def weights(counts: DataFrame, terms: DataFrame, id_column: str) -> DataFrame:
    """(id, term, weight) of unit length per id."""
    by_id = Window.partitionBy(id_column)
    raw = counts.join(terms.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_id))
                          ).select(id_column, "term", "weight")


#: Terms of texts that a task holds on each side at once, besides one text that has more by itself, and the most
#: such chunks of documents that pass through a task.
QUERY_TERMS, DOCUMENT_TERMS, SPAN = 2_000_000, 1_000_000, 16
#: Rows of a block of scores within a task, and terms of a dense product or products of a sparse one at once.
QUERY_ROWS, DOCUMENT_ROWS, DENSE_TERMS, PRODUCTS = 512, 4096, 512, 1 << 20
#: A product by index costs as much as this many by matrix.
SPARSE_COST = 256
#: Scores are compared as they are rounded, to nine digits.
ROUNDED = 1e-9
#: Most columns of a block of which one score is looked at to find a bound, and the share of cells that are summed one by one.
BOUND_COLUMNS, FEW_CELLS = 16, 1 / 32


def text_norms(counts: DataFrame, terms: DataFrame, doc_id: str, heavy: int = 1 << 16) -> DataFrame:
    """(doc_id, norm) over all of a document's ``terms``.

    Terms that make up at least 1 in ``heavy`` of all counts, of which there are no more than ``heavy``, are
    sent to every task, so that only the rarer ones move to meet their weights.
    """
    total = counts.count()
    common = F.broadcast(terms.filter(F.col("df") * heavy >= total).select("term", F.col("idf").alias("common")))
    first = counts.join(common, "term", "left")
    w = F.col("tf") * F.col("idf")
    parts = first.filter("common is not null").select(doc_id, (F.col("tf") * F.col("common")).alias("w")).unionByName(
        first.filter("common is null").join(terms.filter(F.col("df") * heavy < total).select("term", "idf"), "term")
        .select(doc_id, w.alias("w")))
    return parts.groupBy(doc_id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) of the terms of ``table``."""
    terms, values = (table.column(c).combine_chunks() for c in ("terms", "amounts"))
    row = np.repeat(np.arange(table.num_rows), pc.list_value_length(terms).to_numpy())
    return row, terms.flatten().to_numpy(), values.flatten().to_numpy()


def _alike(row: np.ndarray, rank: np.ndarray, rows: int) -> np.ndarray:
    """An order of the rows in which those with the same two commonest terms are neighbours."""
    first = np.full(rows, np.iinfo(np.int64).max)
    second = first.copy()
    np.minimum.at(first, row, rank)
    others = rank != first[row]
    np.minimum.at(second, row[others], rank[others])
    return np.lexsort((second, first))


def _within(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places of all members of groups that begin at ``first``."""
    out = np.arange(many.sum())
    out += np.repeat(first - (np.cumsum(many) - many), many)
    return out


class _Block:
    """Documents of a block by term: rows and values, and where each term begins."""

    def __init__(self, row: np.ndarray, code: np.ndarray, value: np.ndarray, places: np.ndarray):
        self.row, self.value, self.places = row, value, places
        self.first = np.flatnonzero(np.diff(code, prepend=-1))
        self.count = np.diff(np.append(self.first, len(code)))
        self.codes = code[self.first]


class _Best:
    """The ``k`` best documents of each of some queries, among the documents met so far.

    A block of scores is the sum of a product by matrix, over terms in many rows, and of single products by index. It
    is of short floats, which with a bound on their error say which cells can be among the best; these are summed
    in full. Queries and documents with the same common terms stand together, so that a block has terms of its own,
    and a query is left out of a block whose terms cannot bring it to its ``k``-th best score.
    """

    def __init__(self, queries: pa.Table, k: int):
        row, term, value = _entries(queries)
        self.k, self.n = k, queries.num_rows
        self.codes, code = np.unique(term, return_inverse=True)
        self.rank = np.empty(len(self.codes), np.int64)
        self.rank[np.argsort(-np.bincount(code, minlength=len(self.codes)), kind="stable")] = np.arange(len(self.codes))
        order = _alike(row, self.rank[code], self.n)
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        by_row = np.argsort(place[row], kind="stable")
        self.row, self.code, self.value = place[row][by_row], code[by_row], value[by_row]
        self.queries = queries.column("query").take(pa.array(order)).combine_chunks()
        self.score, self.place, self.keys = np.full((self.n, k), -1.0), np.zeros((self.n, k), np.int64), None
        # A sum of n products is off by less than (n + 3) roundings of its value, in whichever order.
        self.slack = 2 * (np.bincount(row, minlength=1).max() + 3) * 2.0 ** -24
        self.kind = np.float32
        if self.slack > 0.01:
            self.slack, self.kind = self.slack * 2.0 ** -29, np.float64
        # Memory that is used again for each block.
        cells = QUERY_ROWS * DOCUMENT_ROWS
        self.scores, self.passed = np.empty(cells, self.kind), np.empty(cells, bool)

    def meet(self, documents: pa.Table) -> None:
        """Compare all queries with some documents, whose ids come after those met before."""
        if not len(self.codes):
            return
        n, base = documents.num_rows, 0 if self.keys is None else len(self.keys)
        row, term, value = _entries(documents)
        by = np.argsort(term)
        code = np.minimum(np.searchsorted(self.codes, term[by]), len(self.codes) - 1)
        real = self.codes[code] == term[by]
        by, code = by[real], code[real]
        row, value = row[by], value[by] / documents.column("norm").to_numpy()[row[by]]
        # The first documents stay mixed: they give every query a score to pass.
        order = _alike(row, self.rank[code], n) if base else np.arange(n)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        row = place[row]
        block = row // DOCUMENT_ROWS
        by = np.argsort(block.astype(np.min_scalar_type(n // DOCUMENT_ROWS)), kind="stable")
        ends = np.searchsorted(block[by], np.arange(n // DOCUMENT_ROWS + 2))
        for b, start in enumerate(range(0, n, DOCUMENT_ROWS)):
            some = by[ends[b]:ends[b + 1]]
            if len(some):
                self._block(_Block(row[some] - start, code[some], value[some], base + order[start:start + DOCUMENT_ROWS]))
        keys = documents.column("doc").combine_chunks()
        self.keys = pa.concat_arrays([self.keys, keys]) if base else keys
        if len(self.keys) > 2 * self.score.size + DOCUMENT_TERMS:
            held, place = np.unique(self.place[self.score >= 0], return_inverse=True)
            self.place[self.score >= 0] = place
            self.keys = self.keys.take(pa.array(held))

    def _block(self, right: _Block) -> None:
        local = np.full(len(self.codes), -1)
        local[right.codes] = np.arange(len(right.codes))
        code = local[self.code]
        known = np.flatnonzero(code >= 0)
        row, code, value = self.row[known], code[known], self.value[known]
        most = np.bincount(row, value * np.maximum.reduceat(right.value, right.first)[code], self.n)
        rows = np.flatnonzero((most > 0) & (most >= self.score[:, -1] - ROUNDED))
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        row = place[row]
        known = np.flatnonzero(row >= 0)
        row, code, value = row[known], code[known], value[known]
        for start in range(0, len(rows), QUERY_ROWS):
            some = slice(*np.searchsorted(row, [start, start + QUERY_ROWS]))
            self._cells(rows[start:start + QUERY_ROWS], row[some] - start, code[some], value[some], right)

    def _cells(self, rows: np.ndarray, row: np.ndarray, code: np.ndarray, value: np.ndarray, right: _Block) -> None:
        """The scores of some queries and a block of documents."""
        n_left, n_right, n_codes = len(rows), len(right.places), len(right.codes)
        often = np.bincount(code, minlength=n_codes) * right.count * SPARSE_COST > n_left * n_right
        dense, by_matrix, made = np.flatnonzero(often), often[code], {}

        def sides(start: int) -> tuple[np.ndarray, np.ndarray]:
            if start not in made:
                made.clear()
                part = dense[start:start + DENSE_TERMS]
                place = np.full(n_codes, -1)
                place[part] = np.arange(len(part))
                own = place[code]
                known = own >= 0
                left, other = np.zeros((n_left, len(part))), np.zeros((n_right, len(part)))
                left[row[known], own[known]] = value[known]
                at = _within(right.first[part], right.count[part])
                other[right.row[at], np.repeat(np.arange(len(part)), right.count[part])] = right.value[at]
                made[start] = left, other
            return made[start]

        parts = range(0, len(dense), DENSE_TERMS)
        scores = self.scores[:n_left * n_right].reshape(n_left, n_right)
        if not parts:
            scores[:] = 0
        for start in parts:
            left, other = (x.astype(self.kind, copy=False) for x in sides(start))
            if start:
                scores += left @ other.T
            else:
                np.matmul(left, other.T, out=scores)
        rare_row, rare_code, rare_value = row[~by_matrix], code[~by_matrix], value[~by_matrix]
        many = right.count[rare_code]
        upto = np.cumsum(np.bincount(rare_row, many, n_left))
        start = 0
        while start < n_left:
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PRODUCTS, "right")))
            some = slice(*np.searchsorted(rare_row, [start, stop]))
            at = _within(right.first[rare_code[some]], many[some])
            cell, product = right.row[at], right.value[at]
            cell += np.repeat((rare_row[some] - start) * n_right, many[some])
            product *= np.repeat(rare_value[some], many[some])
            out = scores[start:stop]
            np.add.at(out.reshape(-1), cell, product.astype(self.kind, copy=False))
            found = self._found(out, rows[start:stop])
            if len(found):
                one, two = np.divmod(found, n_right)
                if self.kind is np.float64:
                    exact = out.reshape(-1)[found]
                elif len(found) > out.size * FEW_CELLS:
                    whole = np.zeros(out.shape)
                    for p in parts:
                        left, other = sides(p)
                        whole += left[start:stop] @ other.T
                    np.add.at(whole.reshape(-1), cell, product)
                    exact = whole.reshape(-1)[found]
                else:
                    met = np.flatnonzero(self.passed[cell])
                    exact = np.zeros(len(found))
                    exact += np.bincount(np.searchsorted(found, cell[met]), product[met], len(found))
                    for p in parts:
                        left, other = sides(p)
                        exact += np.einsum("ij,ij->i", left[start + one], other[two])
                self._keep(rows[start:stop], one, right.places[two], np.round(exact, 9))
            start = stop

    def _found(self, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The cells of ``out`` that may be among the best, besides some that are not."""
        cut = (self.score[rows, -1] - ROUNDED) * (1 - self.slack)
        new, width = np.flatnonzero(self.score[rows, -1] < 0), out.shape[1] // BOUND_COLUMNS
        if len(new) and width >= self.k:
            # The k-th of the best cells of as many groups is no better than the k-th cell.
            best = out[new, :width * BOUND_COLUMNS].reshape(len(new), BOUND_COLUMNS, width).max(axis=1)
            cut[new] = (np.partition(best, -self.k, axis=1)[:, -self.k].astype(float) - ROUNDED) * (1 - 2 * self.slack)
        passed = self.passed[:out.size]
        np.greater_equal(out, np.maximum(cut, np.finfo(self.kind).tiny).astype(self.kind)[:, None], out=passed.reshape(out.shape))
        # Few cells pass, so eight are looked at together.
        whole = out.size // 8 * 8
        some = np.flatnonzero(passed[:whole].view(np.uint64))
        eight, one = np.nonzero(passed[:whole].reshape(-1, 8)[some])
        return np.concatenate([some[eight] * 8 + one, whole + np.flatnonzero(passed[whole:])])

    def _keep(self, rows: np.ndarray, row: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        """Put cells among the best of their rows; earlier places break ties."""
        last = self.score[rows[row], -1]
        better = (score > last) | ((score == last) & (place < self.place[rows[row], -1]))
        row, place, score = row[better], place[better], score[better]
        if not len(row):
            return
        own = np.unique(row)
        row = np.concatenate([np.repeat(own, self.k), row])
        place = np.concatenate([self.place[rows[own]].reshape(-1), place])
        score = np.concatenate([self.score[rows[own]].reshape(-1), score])
        order = np.lexsort((place, -score, row.astype(np.min_scalar_type(len(rows)))))
        row, place, score = row[order], place[order], score[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        self.place[rows[own]] = place[first].reshape(-1, self.k)
        self.score[rows[own]] = score[first].reshape(-1, self.k)

    def rows(self, kinds: tuple[pa.DataType, pa.DataType]) -> Iterator[pa.RecordBatch]:
        for start in range(0, self.n, 1 << 13):
            row, col = np.nonzero(self.score[start:start + (1 << 13)] >= 0)
            if len(row):
                row += start
                yield pa.RecordBatch.from_arrays([
                    self.queries.take(pa.array(row)).cast(kinds[0]), self.keys.take(pa.array(self.place[row, col])).cast(kinds[1]),
                    pa.array(self.score[row, col])], names=["query", "doc", "score"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(task, whether documents, rows), with the terms of a chunk at most besides one text that has more by itself."""
    for batch in batches:
        task, document = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "document"))
        marks = [0, *(np.flatnonzero(np.diff(task * 2 + document)) + 1), batch.num_rows]
        ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy())
        for start, stop in zip(marks, marks[1:]):
            while start < stop:
                upto = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + DOCUMENT_TERMS, "right"))
                upto = min(stop, max(start + 1, upto))
                yield task[start], document[start], batch.slice(start, upto - start)
                start = upto


def _search(k: int, kinds: tuple[pa.DataType, pa.DataType]):
    """The function of a task: queries come first, then documents in the order of their ids, a chunk at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in itertools.groupby(_pieces(batches), lambda piece: piece[0]):
            best, held, size = None, [], 0
            for _, document, piece in pieces:
                if document and best is None:
                    if not held:
                        break
                    best, held = _Best(pa.Table.from_batches(held), k), []
                more = pc.sum(pc.list_value_length(piece.column("terms"))).as_py()
                if document and held and size + more > DOCUMENT_TERMS:
                    best.meet(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(piece)
                size += more if document else 0
            if best is not None:
                best.meet(pa.Table.from_batches(held))
                yield from best.rows(kinds)
        best = held = None
        _give_back()

    return run


def best_documents(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(query, doc, score): the ``k`` best documents per query of every chunk of queries and span of documents.

    ``queries`` has (query, terms, amounts), ``documents`` (doc, norm, terms, amounts); terms are numbers. A task
    holds a chunk of queries while a span of documents passes by; pairs of a document and a query exist only as
    cells of its blocks.
    """
    def chunks(rows: DataFrame, most: int) -> int:
        return max(1, -(-(rows.agg(F.sum(F.size("terms"))).first()[0] or 0) // most))

    n_queries, n_documents = chunks(queries, QUERY_TERMS), chunks(documents, DOCUMENT_TERMS)
    # Long spans hand on fewer rows, but every core is to have some.
    cores = queries.sparkSession.sparkContext.defaultParallelism
    spans = min(n_documents, max(-(-n_documents // SPAN), -(-2 * cores // n_queries)))
    kinds = queries.schema["query"].dataType, documents.schema["doc"].dataType

    def dealt(rows: DataFrame, key: str, own: tuple[int, int], other: tuple[int, int]) -> DataFrame:
        """A row for each task: of its key's number among ``own``, and of every number of the others; both come with their step."""
        first = (F.pmod(F.xxhash64(key), F.lit(own[0])) * own[1]).cast("int")
        return rows.withColumns({"amounts": F.col("amounts").cast("array<double>"), "task": F.explode(
            F.sequence(first, first + (other[0] - 1) * other[1], F.lit(other[1])))})

    by_chunk, by_span = (n_queries, spans), (spans, 1)
    asked = dealt(queries, "query", by_chunk, by_span).select(
        "task", F.lit(False).alias("document"), "query", F.lit(None).cast(kinds[1]).alias("doc"), F.lit(0.0).alias("norm"), "terms", "amounts")
    met = dealt(documents, "doc", by_span, by_chunk).select(
        "task", F.lit(True).alias("document"), F.lit(None).cast(kinds[0]).alias("query"), "doc", "norm", "terms", "amounts")
    schema = T.StructType([T.StructField("query", kinds[0]), T.StructField("doc", kinds[1]), T.StructField("score", T.DoubleType())])
    return (
        asked.unionByName(met).repartitionById(n_queries * spans, "task").sortWithinPartitions("task", "document", "doc")
        .mapInArrow(_search(k, tuple(map(to_arrow_type, kinds))), schema)
    )


def _packed(rows: DataFrame, key: str, amount: Column) -> DataFrame:
    """A row per ``key`` with its terms' numbers and their amounts, which are the terms of one text."""
    grouped = rows.groupBy(key).agg(F.collect_list(F.struct("number", amount.alias("amount"))).alias("held"))
    return grouped.select(key, F.col("held.number").alias("terms"), F.col("held.amount").alias("amounts"))


def _single(rows: DataFrame, key: str) -> bool:
    """Whether every row has an id, and one of its own."""
    return not rows.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).head(1)


def _counted_sides(corpus: DataFrame, queries: DataFrame, doc_id: str, query_id: str, stop_words: list[str],
                   vocabulary_size: int | None) -> tuple[DataFrame, DataFrame]:
    """The two sides of ``best_documents``, from a written row per text and term."""
    n = corpus.count()
    counts = written(term_counts(corpus, doc_id, stop_words=stop_words), "term-counts")
    terms = written(vocabulary(counts, F.lit(n), vocabulary_size), "vocabulary")
    asked = checkpoint(weights(term_counts(queries, query_id, stop_words=stop_words), terms, query_id))
    # Written, as a number must stay with its term.
    numbers = written(terms.join(asked.select("term").distinct(), "term").select(
        "term", "idf", F.monotonically_increasing_id().alias("number")), "asked-terms")
    wanted = asked.join(numbers, "term").select(F.col(query_id).alias("query"), "number", (F.col("weight") * F.col("idf")).alias("part"))
    met = counts.join(numbers, "term").select(F.col(doc_id).alias("doc"), "number", "tf")
    documents = _packed(met, "doc", F.col("tf").cast("int")).join(
        text_norms(counts, terms, doc_id).withColumnRenamed(doc_id, "doc"), "doc")
    return _packed(wanted, "query", F.col("part")), documents


#: Words of texts that are numbered together, and characters of all texts for each bin of terms, of which there are ``LEAST_BINS``.
CHUNK_WORDS, BIN_CHARS, LEAST_BINS = 800_000, 1 << 23, 32


def _give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _numbered(chunk: int, keys: pa.Array, tokens: pa.ListArray, bins: int) -> Iterator[pa.RecordBatch]:
    """The terms of some texts, a row for each of their bins, and a row for each text: the steps between its terms' places among these, and counts."""
    lengths = pc.list_value_length(tokens).to_numpy()
    coded = tokens.flatten().dictionary_encode()
    by_word = pc.sort_indices(coded.dictionary).to_numpy()
    found = coded.dictionary.take(pa.array(by_word))
    rank = np.empty(len(found), np.int64)
    rank[by_word] = np.arange(len(found))
    word, text, width = rank[coded.indices.to_numpy()], np.repeat(np.arange(len(keys)), lengths), len(found) + 1
    near = text[1:] == text[:-1]
    # A word by itself, or with the next one: first * width + (0 or second + 1).
    kinds, kind = np.unique(np.concatenate([word * width, (word[:-1] * width + word[1:] + 1)[near]]), return_inverse=True)
    text = np.concatenate([text, text[1:][near]])
    first, second = np.divmod(kinds, width)
    marks = np.array([zlib.crc32(w) for w in found.cast(pa.binary()).to_pylist()] + [0], np.uint64)
    bin_ = ((marks[first] * np.uint64(0x9E3779B1) + marks[second - 1] * np.uint64(0x85EBCA77)) >> np.uint64(16)) % np.uint64(bins)
    order = np.argsort(bin_, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    names = pc.binary_join_element_wise(found.take(pa.array(first[order])), found.take(pa.array(
        second[order] - 1, mask=second[order] == 0)), " ", null_handling="skip")
    held, sizes = np.unique(bin_[order], return_counts=True)
    cells, tf = np.unique(text * len(kinds) + place[kind], return_counts=True)
    text, kind = np.divmod(cells, max(1, len(kinds)))
    texts = np.bincount(kind, minlength=len(order)).astype(np.int32)
    yield _side(len(held), chunk, keys.type, bin=pa.array(held.astype(np.int32)), names=pc.binary_join(_lists(names, sizes), "\n"), df=_lists(pa.array(texts), sizes))
    sizes = np.bincount(text, minlength=len(keys))
    # Small steps from place to place take less room than places.
    steps = np.diff(kind, prepend=0)
    begun = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[begun] = kind[begun]
    yield _side(len(keys), chunk, keys.type, key=keys, steps=_lists(pa.array(steps.astype(np.int32)), sizes), tf=_lists(pa.array(tf.astype(np.int32)), sizes))


def _side(size: int, chunk: int, key_kind: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"bin": pa.int32(), "names": pa.string(), "df": pa.list_(pa.int32()),
             "key": key_kind, "steps": pa.list_(pa.int32()), "tf": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, chunk, np.int64))] + [
        columns[n].cast(t) if n in columns else pa.nulls(size, t) for n, t in kinds.items()], names=["chunk", *kinds])


def coded_texts(texts: DataFrame, key: str, bins: int, stop_words: list[str], asked: bool = False) -> DataFrame:
    """Chunks of texts: (chunk, bin, names, df) for the terms of a chunk in a bin, a line each, and how many of its texts hold
    each, and (chunk, key, steps, tf) for a text, with the steps from place to place in the chunk's names by bin. Chunks of
    ``asked`` texts are below 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def numbered() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            yield from _numbered(-1 - chunk if asked else chunk, *(table.column(c).combine_chunks() for c in ("key", "tokens")), bins)

        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy())
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                upto = max(start + 1, int(np.searchsorted(ends, before + CHUNK_WORDS - size, "right")))
                held.append(batch.slice(start, upto - start))
                size += ends[upto - 1] - before
                start = upto
                if size >= CHUNK_WORDS or start < batch.num_rows:
                    yield from numbered()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from numbered()
        held.clear()
        _give_back()

    # A table of few pieces would keep most cores idle.
    if texts.rdd.getNumPartitions() < texts.sparkSession.sparkContext.defaultParallelism:
        texts = texts.repartition(key)
    kind = texts.schema[key].dataType
    tokens = texts.select(F.col(key).alias("key"), F.coalesce(words("text", stop_words), F.array().cast("array<string>")).alias("tokens"))
    return tokens.mapInArrow(run, "chunk long, bin int, names string, df array<int>, "
                             f"key {kind.simpleString()}, steps array<int>, tf array<int>")


def _met(rows: pa.Table) -> pa.Table:
    """For each row of a bin, how many documents in all hold each of its terms, and the numbers of asked terms at their places."""
    sizes = pc.list_value_length(rows.column("df").combine_chunks()).to_numpy()
    term = pc.split_pattern(rows.column("names").combine_chunks(), "\n").flatten().dictionary_encode()
    kinds, term = len(term.dictionary), term.indices.to_numpy()
    by_query = np.repeat(rows.column("chunk").to_numpy() < 0, sizes)
    df = np.where(by_query, 0, rows.column("df").combine_chunks().flatten().to_numpy())
    total = np.bincount(term, df, kinds).astype(np.int64)[term]
    number = np.full(kinds, -1, np.int64)
    asked = np.unique(term[by_query])
    number[asked] = (rows.column("bin")[0].as_py() << 32) + np.arange(len(asked))
    number = number[term]
    real, row = np.flatnonzero(number >= 0), np.repeat(np.arange(len(sizes)), sizes)
    at = real - (np.cumsum(sizes) - sizes)[row[real]]
    many = np.bincount(row[real], minlength=len(sizes))
    return pa.table({"chunk": rows.column("chunk"), "bin": rows.column("bin"), "total": _lists(pa.array(total), sizes),
                     "at": _lists(pa.array(at.astype(np.int32)), many), "number": _lists(pa.array(number[real]), many)})


def _weighed(n: int, kind: pa.DataType, asked: bool):
    """The cogroup function of a chunk's texts and its terms' totals: asked terms of each text, and the length of the whole."""
    def run(texts: pa.Table, terms: pa.Table) -> pa.Table:
        terms = terms.sort_by("bin")
        total, at, numbers = (terms.column(c).combine_chunks() for c in ("total", "at", "number"))
        sizes, many = pc.list_value_length(total).to_numpy(), pc.list_value_length(at).to_numpy()
        total = total.flatten().to_numpy()
        number = np.full(len(total), -1, np.int64)
        number[at.flatten().to_numpy() + np.repeat(np.cumsum(sizes) - sizes, many)] = numbers.flatten().to_numpy()
        steps, tf = (texts.column(c).combine_chunks() for c in ("steps", "tf"))
        held = pc.list_value_length(steps).to_numpy()
        row = np.repeat(np.arange(texts.num_rows), held)
        place, tf = np.cumsum(steps.flatten().to_numpy(), dtype=np.int64), tf.flatten().to_numpy()
        # A text's first step is from 0.
        place -= np.concatenate([[0], place])[np.cumsum(held) - held][row]
        idf = np.where(total > 0, np.log((1 + n) / (1 + total)) + 1, 0)[place]
        norm = np.sqrt(np.bincount(row, (tf * idf) ** 2, texts.num_rows))
        real = (number[place] >= 0) & (idf > 0)
        row, tf, idf = row[real], tf[real], idf[real]
        many = np.bincount(row, minlength=texts.num_rows)
        found = {"key": texts.column("key").cast(kind), "norm": pa.array(norm), "terms": _lists(pa.array(number[place[real]]), many),
                 "amounts": _lists(pa.array(tf * idf / norm[row] * idf if asked else tf), many)}
        return pa.table(found).filter(pa.array(many > 0))

    return run


def _coded_sides(corpus: DataFrame, queries: DataFrame, doc_id: str, query_id: str, stop_words: list[str],
                 vocabulary_size: None) -> tuple[DataFrame, DataFrame]:
    """The two sides of ``best_documents``; a term moves once for each chunk of texts that holds it, not for each text.

    Terms of a chunk go to their bins in packed rows, learn there how many documents hold them, and come back to
    the chunk in their order. A bin holds a term once a chunk, however many texts have it.
    """
    n, chars = corpus.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    bins = max(LEAST_BINS, -(-chars // BIN_CHARS))
    sides = [written(coded_texts(*side), name, compression="zstd") for side, name in (
        ((corpus, doc_id, bins, stop_words), "document-terms"), ((queries, query_id, bins, stop_words, True), "query-terms"))]
    terms = [side.filter("bin is not null").select("chunk", "bin", "names", "df") for side in sides]
    totals = written(terms[0].unionByName(terms[1]).groupBy("bin").applyInArrow(
        _met, "chunk long, bin int, total array<long>, at array<int>, number array<long>"), "term-totals")

    def weighed(side: DataFrame, asked: bool) -> DataFrame:
        kind = side.schema["key"].dataType
        schema = f"key {kind.simpleString()}, norm double, terms array<long>, amounts array<{'double' if asked else 'int'}>"
        own = totals.filter(F.col("chunk") < 0 if asked else F.col("chunk") >= 0)
        return side.filter("bin is null").select("chunk", "key", "steps", "tf").groupBy("chunk").cogroup(
            own.groupBy("chunk")).applyInArrow(_weighed(n, to_arrow_type(kind), asked), schema)

    return (weighed(sides[1], True).withColumnRenamed("key", "query").drop("norm"),
            weighed(sides[0], False).withColumnRenamed("key", "doc"))


def tfidf_search(corpus: DataFrame, queries: DataFrame, k: int = 10,
                 doc_id: str = "doc_id", query_id: str = "query_id",
                 vocabulary_size: int | None = None,
                 stop_words: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` most similar documents by cosine.

    Documents that share no term with the query are not listed. Only the asked
    terms of documents meet queries, as products of blocks of both in a task, which
    hands on its best rows only. The rows of an id that occurs more than once are
    one text; then, or with a vocabulary of a given size, a row per text and
    term moves.
    """
    whole = vocabulary_size is None and _single(corpus, doc_id) and _single(queries, query_id)
    sides = _coded_sides if whole else _counted_sides
    asked, documents = sides(corpus, queries, doc_id, query_id, dims.STOP_WORDS if stop_words is None else stop_words, vocabulary_size)
    found = best_documents(written(asked, "queries"), written(documents, "documents"), k)
    scores = found.select(F.col("doc").alias(doc_id), F.col("query").alias(query_id), "score")
    by_query = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
    return scores.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)


def query_metrics(ranked: DataFrame, truth: DataFrame, query_id: str = "query_id",
                  doc_id: str = "doc_id", k: int = 10) -> DataFrame:
    """Precision, recall and average precision per query.

    ``ranked`` holds (query, document, rank); the query's own document is
    taken out first and the ranks close up. ``truth`` holds (query, document).
    """
    others = ranked.filter(~F.col(query_id).eqNullSafe(F.col(doc_id)))
    by_query = Window.partitionBy(query_id).orderBy("rank")
    marked = (
        others.withColumn("place", F.row_number().over(by_query)).filter(F.col("place") <= k)
        .join(truth.select(query_id, doc_id, F.lit(1).alias("hit")), [query_id, doc_id], "left")
        .withColumn("hit", F.coalesce("hit", F.lit(0)))
        .withColumn("hits_so_far", F.sum("hit").over(
            by_query.rowsBetween(Window.unboundedPreceding, 0)))
    )
    found = marked.groupBy(query_id).agg(
        F.count("*").alias("n_listed"), F.sum("hit").alias("n_hits"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits_so_far") / F.col("place")).otherwise(0.0))
        .alias("precision_sum"))
    relevant = truth.groupBy(query_id).agg(F.count("*").alias("n_relevant"))
    zero = F.lit(0.0)
    return relevant.join(found, query_id, "left").select(
        query_id,
        F.coalesce(F.col("n_hits") / F.col("n_listed"), zero).alias("precision_at_k"),
        F.coalesce(F.col("n_hits") / F.col("n_relevant"), zero).alias("recall_at_k"),
        F.coalesce(F.col("precision_sum") / F.col("n_relevant"), zero).alias("average_precision"))


def mean_metrics(per_query: DataFrame, *group: str) -> DataFrame:
    """Means over all queries, or per group of queries."""
    return per_query.groupBy(*group).agg(
        F.round(F.avg("precision_at_k"), 4).alias("precision_at_k"),
        F.round(F.avg("recall_at_k"), 4).alias("recall_at_k"),
        F.round(F.avg("average_precision"), 4).alias("mean_average_precision"),
        F.count("*").alias("n_queries"))


def prepare_text(texts: DataFrame, text_column: str = "text",
                 max_chars: int | None = None) -> DataFrame:
    """Non-empty texts, trimmed for embedding, with ``truncated``; cut only if ``max_chars`` is given."""
    trimmed = F.trim(text_column)
    rows = texts.filter(F.length(trimmed) > 0).withColumn("_text", trimmed)
    if max_chars is None:
        return rows.withColumns({"prepared": F.col("_text"), "truncated": F.lit(False)}).drop("_text")
    return (
        rows.withColumn("prepared", truncate_at_sentence("_text", max_chars))
        .withColumn("truncated", F.length("_text") > max_chars).drop("_text")
    )


Encoder = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def embed_text(texts: DataFrame, id_column: str, text_column: str = "text", dim: int = 256,
               output: str = "embedding") -> DataFrame:
    """(id, vector): hashed TF-IDF of unit length; a text without words has no row.

    A term's place is the number in the first seven digits of its md5, modulo ``dim``;
    ``idf = ln((1 + n) / (1 + df)) + 1`` by place, over the texts that have words.
    """
    place = F.conv(F.substring(F.md5("term"), 1, 7), 16, 10).cast("bigint") % dim
    counts = texts.select(id_column, F.explode(words(text_column, [])).alias("term")).groupBy(
        id_column, place.alias("place")).agg(F.count("*").alias("tf"))
    n = counts.select(id_column).distinct().count()
    # At most ``dim`` rows.
    idf = counts.groupBy("place").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf"))
    by_id = Window.partitionBy(id_column)
    weighed = counts.join(F.broadcast(idf), "place").withColumn("w", F.col("tf") * F.col("idf")).withColumn(
        "w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_id)))
    held = weighed.groupBy(id_column).agg(F.map_from_entries(
        F.collect_list(F.struct("place", "w"))).alias("held"))
    return held.select(id_column, F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(dim - 1).cast("bigint")),
        lambda i: F.coalesce(F.col("held")[i], F.lit(0.0))).alias(output))


def encode_text(texts: DataFrame, text_column: str, encoder: Encoder, output: str = "embedding") -> DataFrame:
    """Add a vector column by a model: ``encoder`` maps an iterator over batches of texts to batches of vectors."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from encoder(batches)

    return texts.withColumn(output, F.pandas_udf(run, "array<float>")(text_column))
