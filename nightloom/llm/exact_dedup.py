"""Exact deduplication that no group of copies can skew.

Copies are combined three times: within each map task, within salted parts of a digest group, and across the salts'
winners.  Every combine groups by the digest and the whole text, so equal digests of different texts stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, has_rows
from .registry import register, table

SALTS = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each input row; of equal texts the largest doc_id stays.

    Null texts count as empty and form one group with empty ones.  Null ids are smaller than all others; a group of null
    ids only has keep_id null.  Rows that share the largest id of their group are all marked kept.  Texts of any length
    are compared whole; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    salted = rows.groupBy("digest", salt.alias("salt"), "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # one row for each digest, without the text; texts counts the different ones under it
    winners = cut(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        )
    )
    members = rows.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256")).join(winners.filter("texts = 1"), "digest")
    if has_rows(winners.filter("texts > 1")):  # a digest that several texts share decides nothing: go by the texts
        shared = winners.filter("texts > 1").select("digest")
        apart = groups.join(shared, "digest", "left_semi")
        more = rows.join(apart, ["digest", "text"]).withColumn("text_sha256", F.sha2("text", 256))
        members = members.drop("texts").unionByName(more.drop("text"))
    return members.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


@register(
    "op10_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
