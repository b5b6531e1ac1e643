"""Marks of complete versions: tables that a batch has written count once its mark is there."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def last_version(spark: SparkSession, folder: str, before: int) -> int | None:
    """The newest complete version of the tables below a folder that is older than ``before``."""
    try:
        marks = spark.read.schema("version bigint").parquet(f"{folder}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return marks.filter(F.col("version") < before).agg(F.max("version").alias("v")).first().v


def mark_version(spark: SparkSession, folder: str, version: int) -> None:
    """Say that a version is complete: one file, written last."""
    spark.range(version, version + 1, 1, 1).select(F.col("id").alias("version")).write.mode("overwrite").parquet(
        f"{folder}/versions/batch={version}")
