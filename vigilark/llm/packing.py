"""Best-fit packing: a configuration linear program over the length histogram, then rounding.

The histogram has at most ``capacity`` rows, so planning is small work whatever the corpus. Patterns
(multisets of lengths that fit one sequence) come from a bounded-knapsack dynamic program that prices
lengths by multiplicative weights: a length that is covered less weighs more. The fractional pattern
counts are rounded down, what they leave is packed best-fit by groups of equal sequences, and pieces
find their place by their rank among the pieces of their length.

Defined cases: a null text is an empty one and packs as the end id alone; a null id stays null; repeated
rows are packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilark.llm.common import Batches, sliced, written
from vigilark.llm.subwords import WordEncoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length that are ranked in one group.
RANKED = 500


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: the text's ids and the end id, cut every ``capacity`` ids."""

    def cut(batches: Batches) -> Batches:
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            for part in sliced(batch, "text"):
                ids, ends = encoder.texts(part.column("text"))
                rows = defaultdict(list)
                for i, doc in enumerate(part.column("id").to_pylist()):
                    own = np.append(ids[ends[i]:ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start:start + capacity]
                        rows["doc_id"].append(doc)
                        rows["piece"].append(k)
                        rows["start"].append(start)
                        rows["length"].append(len(piece))
                        rows["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                yield pa.RecordBatch.from_pydict(rows, pa.schema([
                    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def best_pattern(lengths: np.ndarray, counts: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many pieces of each length make the most worth in one sequence: a bounded knapsack."""
    items = []
    for j, (size, most) in enumerate(zip(lengths.tolist(), np.minimum(counts, capacity // lengths).tolist())):
        step = 1
        while most > 0:  # 1, 2, 4 ... pieces at once, so that every count up to the limit can be made
            step = min(step, most)
            items.append((j, step, size * step))
            most -= step
            step *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), bool)
    for i, (j, step, size) in enumerate(items):
        more = best[:capacity + 1 - size] + worth[j] * step
        better = more > best[size:]
        taken[i, size:] = better
        best[size:] = np.where(better, more, best[size:])
    pattern, left = np.zeros(len(lengths), np.int64), capacity
    for i in range(len(items) - 1, -1, -1):
        if taken[i, left]:
            j, step, size = items[i]
            pattern[j] += step
            left -= size
    return pattern


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int,
                   rate: float = 2.0) -> dict[bytes, float]:
    """The fractional solution: how often each pattern is used."""
    covered = np.zeros(len(lengths))
    weight = np.zeros(len(lengths))
    shares: dict[bytes, float] = defaultdict(float)
    for _ in range(rounds):
        rest = np.maximum(counts - covered, 0)
        if not (rest >= 1).any():
            break
        # The packing rule's dual prices: a piece is worth its length, raised while its cover lags behind.
        worth = np.where(rest >= 1, lengths * np.exp(weight - weight.max()), 0.0)
        pattern = best_pattern(lengths, np.floor(rest).astype(np.int64), worth, capacity)
        if not pattern.any():
            break
        used = pattern > 0
        step = max(1.0, np.floor((rest[used] / pattern[used]).min() / 2))
        shares[pattern.tobytes()] += step
        covered += step * pattern
        weight = -rate * covered / counts
    return shares


def rounded(shares: dict[bytes, float], counts: np.ndarray, part: float) -> list[tuple[np.ndarray, int]]:
    """``part`` of each pattern's use, rounded down so that no length is used more often than it occurs."""
    out, left = [], counts.copy()
    for key, share in sorted(shares.items(), key=lambda x: (-x[1], x[0])):
        pattern = np.frombuffer(key, np.int64)
        used = pattern > 0
        times = min(int(share * part), int((left[used] // pattern[used]).min()))
        if times > 0:
            left = left - times * pattern
            out.append((pattern, times))
    return out


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over counts: (pieces by length, number of equal sequences)."""
    open_: dict[int, list[tuple[tuple, int]]] = defaultdict(list)  # by space left: contents, number
    spaces: list[int] = []
    import bisect

    def put(left: int, content: tuple, number: int) -> None:
        if left not in open_:
            bisect.insort(spaces, left)
        open_[left].append((content, number))

    for size, count in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        while count > 0:
            at = bisect.bisect_left(spaces, size)
            if at < len(spaces):
                left = spaces[at]
                content, number = open_[left].pop()
                if not open_[left]:
                    del open_[left], spaces[at]
            else:
                left, content, number = capacity, (), -(-count // (capacity // size))
            each = min(left // size, count)
            full = min(number, count // each)
            put(left - each * size, (content, size, each), full)
            count -= full * each
            if number > full:
                if count and count < each:
                    put(left - count * size, (content, size, count), 1)
                    full, count = full + 1, 0
                if number > full and content:
                    put(left, content, number - full)
    out = []
    for groups in open_.values():
        for content, number in groups:
            held: dict[int, int] = defaultdict(int)
            while content:
                content, size, each = content
                held[size] += each
            out.append((dict(held), number))
    return out


def plan(histogram: dict[int, int], capacity: int, rounds: int,
         parts: tuple[float, ...] = (1.0, 0.9, 0.75, 0.5)) -> list[tuple[dict[int, int], int]]:
    """(pieces by length, number of equal sequences) for a whole histogram.

    Rounding down leaves pieces that no pattern takes; of the ``parts`` of the fractional solution that
    are tried, the one that needs the fewest sequences in all is used.
    """
    out = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    sizes = np.array(sorted(n for n in histogram if n < capacity), np.int64)
    if not len(sizes):
        return out
    counts = np.array([histogram[n] for n in sizes.tolist()], np.int64)
    shares = configurations(sizes, counts, capacity, rounds)
    best: list[tuple[dict[int, int], int]] | None = None
    for part in parts:
        layout, left = [], counts.copy()
        for pattern, times in rounded(shares, counts, part):
            layout.append(({int(sizes[j]): int(pattern[j]) for j in np.flatnonzero(pattern)}, times))
            left -= times * pattern
        layout += best_fit(sizes[left > 0], left[left > 0], capacity)
        if best is None or sum(n for _, n in layout) < sum(n for _, n in best):
            best = layout
    return out + best


def slots(layout: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For ranges of ranks by length: length, first rank, first sequence, number of sequences, offset."""
    rows, filled, sequence = [], defaultdict(int), 0
    for held, number in layout:
        offset = 0
        for size in sorted(held, reverse=True):
            rows.append((size, filled[size], sequence, number, offset))
            filled[size] += held[size] * number
            offset += size * held[size]
        sequence += number
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table.T)


def pack(cut: DataFrame, capacity: int = 4096, rounds: int = 200) -> DataFrame:
    """``cut`` (rows of ``pieces``) with sequence_id and offset.

    The histogram is the only thing the driver reads: ``capacity`` rows at most. ``rounds`` bounds the
    priced patterns. Ranks within one length are taken in groups of about ``RANKED`` pieces, so a length
    that a third of all pieces share is ranked by many tasks.
    """
    cut = written(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    size, first, sequence, number, offset = slots(plan(histogram, capacity, rounds))
    key = size * (1 << 50) + first if len(size) else np.zeros(0, np.int64)

    def place(batches: Batches) -> Batches:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, length * (1 << 50) + rank, "right") - 1
            nth = rank - first[at]
            found = [sequence[at] + nth % number[at], offset[at] + nth // number[at] * length]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *(pa.array(x, pa.int64()) for x in found)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    parts = F.create_map(*[F.lit(x) for n, c in histogram.items() for x in (n, c // RANKED + 1)]) if histogram \
        else F.create_map(F.lit(0).cast("long"), F.lit(1).cast("long"))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = cut.withColumn("part", F.pmod(F.xxhash64(*order), parts[F.col("length")]))
    own = Window.partitionBy("length", "part").orderBy(*order)
    ranked = dealt.withColumn("nth", F.row_number().over(own) - 1)
    before = (dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
              .drop("n"))
    return (ranked.join(before, ["length", "part"])
            .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
            .mapInArrow(place, f"{PIECES}, sequence_id long, offset long"))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, rounds: int = 200,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place in as few sequences of ``capacity`` ids as can be."""
    return pack(pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col), capacity, rounds)
