"""Documents to packed training sequences: five stages, each an operator of vigilark.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's docs. All but the last return the columns of their docs. Columns that a stage adds for its own
use get names that docs does not have.

Defined cases: a null or letterless text goes in the first stage; rows without id are never duplicates of
others; of rows that repeat one id, one stays after the third stage; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilark.llm import language, neardup, packing, quality, secret_scan
from vigilark.llm.common import prepared, table, written

#: A language that is less likely than this is not known well enough.
LEAST_SCORE = 0.5
CAPACITY = 4096


def fresh(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    prepared(spark)
    found = fresh("found_language", docs)
    known = language.identify(docs, language.train(docs), column=found)
    return known.filter((F.col(f"{found}.pred") != language.UNKNOWN) & (F.col(f"{found}.score") >= LEAST_SCORE)).select(docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    prepared(spark)
    rules = quality.learn(*quality.labelled(docs, table(spark, sf_dir, "labels")))
    column = fresh(quality.COLUMN, docs)
    measured = quality.statistics(docs, column=column)
    return measured.filter(~quality.base_failed(column) & quality.verdict(rules, column)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    prepared(spark)
    kept = neardup.groups(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    nth = fresh("nth", docs)
    order = Window.partitionBy("doc_id").orderBy("text")
    some = docs.join(kept, "doc_id", "left_semi").withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1)
    return some.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced in the text; n_chars follows where a text has changed."""
    prepared(spark)
    clean = fresh("clean_text", docs)
    out = docs.withColumn(clean, secret_scan.redacted(F.col("text"), secret_scan.train(docs)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(clean).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(
            F.length(clean).cast(docs.schema["n_chars"].dataType)))
    return out.withColumn("text", F.col(clean)).select(docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences."""
    prepared(spark)
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]
#: Models that are fitted on the way cannot be written in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
