"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

1. Every document gets its shingle set's size, a 128-bit digest, a sketch and the numbers of its bands.
   Documents with equal sets collapse to one, so large groups of copies cost no pairs.
2. Documents that share a band meet in a bucket. Each bucket is first compared with one hub, the member
   that shares most with others: the original of a family of copies shares more than its copies do. A hub's
   members are dealt out in chunks, and a chunk is compared one text after another with the hub's set.
3. Links join documents to components. Buckets that still hold several components are compared in
   tiles of sketches; only pairs of different components whose sketches agree often enough, by the
   sketch's concentration, are compared as sets. So no bucket is ever expanded into all its pairs.

A link is missed only if no band agrees, which at similarity 0.75 has a probability of
(1 - 0.75^4)^32 = 5e-6, or if a sketch of 512 bins falls four deviations short.

Defined cases: texts that are null or without words are linked with nothing; fewer words than a shingle
make one shingle; rows without id have no component and are kept; rows with one id are one document in
links; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilark.llm.common import Batches, sliced, written
from vigilark.llm.shingles import Sketcher, bands, digest, shingle_sets
from vigilark.operators.clusters import connected_components

SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"
#: Members that one task compares with a hub's set, and members of a tile's side.
CHUNK, SIDE = 500, 500


def sketches(docs: DataFrame, width: int, bins: int, band_rows: int, banded: int) -> DataFrame:
    """A row per document (id, text); bands cover the first ``banded`` bins, the sketch keeps 8 bits of each bin."""

    def run(batches: Batches) -> Batches:
        sketcher = Sketcher(bins)
        for batch in batches:
            for part in sliced(batch, "text"):
                rows = [(0, 0, 0, [], b"")] * part.num_rows
                for i, keys in enumerate(shingle_sets(part.column("text"), width)):
                    if len(keys):
                        found = sketcher(keys)
                        rows[i] = (len(keys), *digest(keys), bands(found[:banded], band_rows),
                                   (found & np.uint64(255)).astype(np.uint8).tobytes())
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                names = ["n_shingles", "d1", "d2", "bands", "sketch"]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))],
                    names=["doc_id", *names])

    return docs.mapInArrow(run, SKETCH)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have 100 * intersection >= percent * union.

    ``a`` is the side to repeat: its text goes once to every chunk of its partners, each of which
    streams past it, so a task holds one set of ``a`` at a time.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    ones = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
                        F.lit(0).alias("role"), F.col("a").alias("id"))
    others = pairs.join(sizes, "a").select(
        "a", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"), F.lit(1).alias("role"), F.col("b").alias("id"))
    rows = (ones.unionByName(others).join(texts, "id").repartition("a", "chunk")
            .sortWithinPartitions("a", "chunk", "role").select("a", "chunk", "role", "id", "text"))

    def run(batches: Batches) -> Batches:
        key, held = None, []
        for batch in batches:
            for part in sliced(batch, "text"):
                found: tuple[list, list] = ([], [])
                sets = shingle_sets(part.column("text"), width)
                columns = [part.column(k).to_pylist() for k in ("a", "chunk", "role", "id")]
                for a, chunk, role, other, own in zip(*columns, sets):
                    if key != (a, chunk):
                        key, held = (a, chunk), []
                    if role == 0:
                        held.append(own)
                        continue
                    for one in held:
                        both = len(np.intersect1d(one, own, assume_unique=True))
                        if 100 * both >= percent * (len(one) + len(own) - both) > 0:
                            found[0].append(a)
                            found[1].append(other)
                            break
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def close_in_tiles(members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different components within a bucket whose sketches agree in ``least`` of their bins.

    ``members``: band, id, component, sketch, bands. A bucket of more than ``SIDE`` members is compared tile by
    tile. Members that share several buckets are a pair in the first of them only.
    """
    sides = members.groupBy("band").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides"))
    dealt = members.join(sides, "band").withColumn("side", F.pmod(F.xxhash64("id"), "sides").cast("int"))
    first = dealt.withColumn("other", F.explode(F.sequence(F.col("side"), F.col("sides") - 1)))
    second = dealt.withColumn("other", F.col("side")).withColumn(
        "side", F.explode(F.filter(F.sequence(F.lit(0), F.col("sides") - 1), lambda s: s < F.col("other"))))
    left = first.select("band", "side", "other", F.lit(True).alias("left"), "id", "component", "sketch", "bands")
    right = second.select("band", "side", "other", F.lit(False).alias("left"), "id", "component", "sketch", "bands")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, components = rows.column("id").to_numpy(), rows.column("component").to_numpy()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        left = np.flatnonzero(rows.column("left").to_numpy(zero_copy_only=False))
        right = np.flatnonzero(~rows.column("left").to_numpy(zero_copy_only=False))
        bands_ = np.array(rows.column("bands").to_pylist(), np.int64)
        same, here = key[1].as_py() == key[2].as_py(), key[0].as_py()
        a, b = [], []
        for k, i in enumerate(left.tolist()):
            to = left[k + 1:] if same else right
            to = to[components[to] != components[i]]
            if len(to):
                near = to[(sketch[to] == sketch[i]).mean(axis=1) >= least]
                shared = bands_[near] == bands_[i]
                first = bands_[i][shared.argmax(axis=1)]
                near = near[(first == here) | ~(shared & (bands_[near] == here)).any(axis=1)]
                a.append(np.minimum(ids[near], ids[i]))
                b.append(np.maximum(ids[near], ids[i]))
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(a or none), pa.int64()),
                         "b": pa.array(np.concatenate(b or none), pa.int64())})

    # Dealt by tile, not by bucket as the joins above are, so that a large bucket's tiles are many tasks.
    tiles = left.unionByName(right).repartition("band", "side", "other")
    return tiles.groupBy("band", "side", "other").applyInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75,
           bins: int = 512, band_rows: int = 4, banded: int = 128) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable), kept (it is the smallest)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = written(sketches(texts, width, bins, band_rows, banded), "sketches")
    digests = ["d1", "d2", "n_shingles"]
    some = sketched.filter("doc_id is not null and n_shingles > 0")
    firsts = some.groupBy(*digests).agg(F.min("doc_id").alias("id"))
    distinct = written(some.join(firsts, digests).filter("doc_id = id").select("id", "bands", "sketch")
                       .dropDuplicates(["id", "bands"]), "distinct")

    rows = distinct.select(F.explode("bands").alias("band"), "id")
    several = rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(rows.join(several, "band").select("band", "id", "n").distinct(), "buckets")
    texts = written(
        texts.filter("doc_id is not null").join(shared.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("id"), "text"), "texts")

    # The hub of a bucket is the member with the most company over all its buckets; ties go by a hash.
    company = shared.groupBy("id").agg(F.sum(F.floor(64 * F.log2("n"))).alias("company"))
    ranked = shared.join(company, "id").withColumn(
        "worth", F.col("company") * (1 << 30) + F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    hubs = ranked.groupBy("band").agg(F.max_by("id", "worth").alias("hub"))
    stars = written(shared.join(hubs, "band").filter("id <> hub")
                    .select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    # An id with several texts links them: it is one document.
    own = some.join(firsts, digests).select("doc_id", "id")
    several = own.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a < last")
    same = own.join(several, "doc_id").filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    links = written(verified(stars, texts, width, percent).unionByName(same), "links")
    component = connected_components(links).withColumnRenamed("cluster", "component")

    members = shared.join(component, "id", "left").select(
        "band", "id", F.coalesce("component", "id").alias("component"))
    mixed = members.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_ = members.join(mixed.select("band"), "band").join(
        distinct, "id")
    least = percent / 100 - 4 * (percent / 100 * (1 - percent / 100) / bins) ** 0.5
    close = close_in_tiles(open_.select("band", "id", "component", "sketch", "bands"), least)
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    late = written(verified(written(close.join(tested, ["a", "b"], "left_anti"), "close"), texts, width, percent), "late")
    if not late.isEmpty():
        component = connected_components(links.unionByName(late)).withColumnRenamed("cluster", "component")

    found = (sketched.select("doc_id", *digests).join(firsts, digests, "left")
             .join(component, "id", "left")
             .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("doc_id"))))
    own = F.col("doc_id").isNull()
    return found.select(
        "doc_id", "n_shingles", F.when(~own, F.col("component_id")).alias("component_id"),
        (own | (F.col("doc_id") == F.col("component_id"))).alias("kept"))
