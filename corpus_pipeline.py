"""Corpus pipeline: from raw documents to packed batches.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from nightloom.llm._shared import ids_unique, scratch, stored
from nightloom.llm.registry import table


KEY = "__row_key"


def _kept(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of docs that ``judge(rows, key)`` marks kept, by a key that names one row.

    The key is doc_id where ids are unique and never null.  Otherwise it is a number in the order of doc_id (null first),
    written with the rows before they are judged, so that rows which share an id are decided one by one.
    """
    if ids_unique(docs):
        return docs.join(judge(docs, "doc_id").filter("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn(KEY, F.monotonically_increasing_id())
    rows = stored(ordered, "pipeline-rows")
    kept = judge(rows, KEY).filter("kept").select(F.col("doc_id").alias(KEY))
    return rows.join(kept, KEY, "left_semi").select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go; null and empty texts are scored too, repeated rows share their score."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null counts as empty, of rows that share that id one stays."""
    return _kept(docs, lambda rows, key: exact_dedup.exact_dedup(rows, doc_id=key))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at similarity 0.8 of five-word shingles, the one with the least doc_id stays; texts without words all stay."""
    return _kept(docs, lambda rows, key: near_dedup.near_dedup(rows, width=5, percent=80, doc_id=key))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts stay, each row is judged by its text."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row that is left gets a bucket, a batch and a place; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The classifier and the alignment have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
