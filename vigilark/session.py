"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import vigilark

SETTINGS = {
    # Event times are compared as UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    # A key=value or JSON line may repeat a key; the last one counts.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}


# Only settable before the session starts: call sites of single column
# operations are not recorded, which halves the time to build a query.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the jobs rely on; partition counts stay the cluster's choice."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    # The few functions that run in Python tasks travel with the job, so
    # executors need no installed copy of the package.
    cloudpickle.register_pickle_by_value(vigilark)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many pieces as the setting ``vigilark.input.pieces`` says; as it is without one.

    Only for trial runs on tables of a single row group, which one core would read alone.
    """
    pieces = df.sparkSession.conf.get("vigilark.input.pieces", None)
    return df if pieces is None else df.repartition(int(pieces))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one is made only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="vigilark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so lineage ends there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that is written and read back."""
    return f"{shared_dir(spark).rstrip('/')}/vigilark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and read by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
