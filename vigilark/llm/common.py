"""What the operators of this package share: tables, folders, and batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilark.session import configure, scratch_path

Batches = Iterator[pa.RecordBatch]

#: Bytes of text that a task holds at once, besides one text that is longer by itself.
SLICE_BYTES = 8 << 20
#: Rows that Spark hands to a Python task at once.
BATCH_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """The library's settings, and small Arrow batches, as a document may be long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def keep_freed() -> None:
    """Lets this process keep up to 64 MB that it has freed for its next arrays.

    The allocator gives memory at the end of its heap back to the system beyond twice the largest block freed so far. For many
    short steps on arrays of some MB, getting the pages back costs more than the steps. The block here is never touched.
    """
    np.empty(31 << 20, np.uint8)


def give_back(batches: Batches) -> Batches:
    """``batches``; once they end, what this process has freed goes back to the system, as Spark keeps it for later tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with at most ``most`` bytes in ``column``, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)
