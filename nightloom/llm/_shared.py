"""Row keys, reliable cuts and small Spark helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on a local master, as in tests, may leave it unset: driver and executors are then one process and
    the warehouse folder serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read these rows and never recompute them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: written once, in columns, and read back."""
    spark = df.sparkSession
    folder = scratch(spark, name)
    df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def ids_unique(docs: DataFrame, doc_id: str = "doc_id") -> bool:
    """Whether no id is null and none occurs twice; reads the id column only."""
    twice = docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(doc_id).isNull())
    return not has_rows(twice)


def keyed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Column]:
    """(rid, text) or (rid, doc_id, text), and the id as a column of it.

    rid is a long that names a row: its id where ids are unique and never null, else a hash of id and text.  Equal rows
    share a key then, which is right for every use here: what holds for one holds for the other.
    """
    if ids_unique(docs, doc_id):
        rows = docs.select(F.col(doc_id).cast("long").alias("rid"), F.col(text).alias("text"))
        return rows.filter("rid is not null"), F.col("rid")  # as inner joins ask too, so that shuffles are reused
    key = F.xxhash64(F.col(doc_id), F.col(text))
    return docs.select(key.alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), F.col("doc_id")


def gapless(df: DataFrame, group: str, spread: list[str], order: list[str], out: str, slots: int = 512) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each value of ``group``, without putting a group into one task.

    Rows fall into ``slots`` slots by a hash of ``spread``; only a slot is sorted by one task, and its first number is
    a running sum over the small table of slot counts (values of ``group`` x slots; few groups are assumed).
    """
    from pyspark.sql import Window as W

    slot = "__slot"
    df = df.withColumn(slot, F.pmod(F.xxhash64(*spread), F.lit(slots)).cast("int"))
    counts = df.groupBy(group, slot).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(
        group, slot,
        (F.sum("__n").over(W.partitionBy(group).orderBy(slot).rowsBetween(W.unboundedPreceding, -1))).alias("__base"),
    ).na.fill(0, ["__base"])
    inside = W.partitionBy(group, slot).orderBy(*order)
    return (
        df.withColumn("__at", F.row_number().over(inside) - 1)
        .join(before, [group, slot])
        .withColumn(out, (F.col("__base") + F.col("__at")).cast("long"))
        .drop(slot, "__at", "__base")
    )
