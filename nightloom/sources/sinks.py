"""Keyed writes.  All of them are exact under retries and hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import finite, hash_prefix


def pick_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = True) -> DataFrame:
    """One whole row per key, the last (or first) in ``order``.

    A struct maximum, not ``row_number``: it combines map-side, so a key that
    holds a third of all rows reaches the reducer as one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    pick = F.max_by if last else F.min_by
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return out.select(*keys, "_row.*").select(*df.columns)


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keyed replace: the newest version of each key wins."""
    return pick_per_key(existing.unionByName(incoming, allowMissingColumns=True), keys, order, last=True)


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows to append: first per key inside the batch, keys already stored left out."""
    return pick_per_key(incoming, keys, order, last=False).join(existing.select(*keys), list(keys), "left_anti")


def backfill(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: dict[str, str], zero_is_missing: Sequence[str]) -> DataFrame:
    """Fill NULL (and, where named, 0) cells from one source row per key."""
    src = source.select(*keys, *[F.col(s).alias(f"_s_{t}") for t, s in columns.items()])
    joined = target.join(src, list(keys), "left")
    for t in columns:
        have = F.nullif(F.col(t), F.lit(0)) if t in zero_is_missing else F.col(t)
        joined = joined.withColumn(t, F.coalesce(have, F.col(f"_s_{t}")))
    return joined.select(*target.columns)


def write_partitions(df: DataFrame, path: str, by: str = "month") -> None:
    """Overwrite only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def merge_into(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column | str], by: str = "month") -> None:
    """Upsert on a month-partitioned folder: only touched months are read and rewritten.

    The months of a batch (null among them), a list that the calendar bounds, become a literal filter that prunes the scan.  Only a folder
    without any file counts as a new table; a read that fails ends the merge and leaves the stored rows alone.  The
    merged rows go through the shared folder first because a plan cannot overwrite what it reads.
    """
    from ..session import cut_lineage

    if not has_files(spark, path):
        write_partitions(pick_per_key(incoming, keys, order), path, by)
        return
    months = [r[0] for r in incoming.select(by).distinct().collect()]
    if not months:
        return
    stored = spark.read.option("basePath", path).parquet(path)
    named = [m for m in months if m is not None]
    touched = F.col(by).isin(named) if named else F.lit(False)
    if len(named) < len(months):  # rows without a month have a partition of their own
        touched = touched | F.col(by).isNull()
    touched = stored.where(touched)
    write_partitions(cut_lineage(upsert_latest(touched, incoming, keys, order)), path, by)


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder of any file system Spark knows holds a visible entry."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(where) and any(not x.getPath().getName().startswith(("_", ".")) for x in system.listStatus(where))


def replace_person(df: DataFrame, email: str = "email") -> DataFrame:
    """Identity rows with the address reduced to a hash prefix."""
    return df.withColumn("email_key", hash_prefix(email)).drop(email)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every (nested) floating column."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return finite(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.StructType):
            inner = F.struct(*[clean(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
            return F.when(c.isNotNull(), inner)
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: clean(v, kind.valueType))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_metrics_json(df: DataFrame, path: str, generated_at: str) -> None:
    json_safe(df).withColumn("generated_at", F.lit(generated_at)).write.mode("overwrite").json(path)


def write_series(df: DataFrame, path: str) -> None:
    """Actual, predicted and band per day, for charts."""
    df.select("entity_id", "metric", "day", "actual", "pred", "lo", "hi").write.mode("overwrite").parquet(path)


def missing_artifacts(expected: DataFrame, produced: DataFrame, key: str = "artifact") -> DataFrame:
    return expected.join(produced.select(key), key, "left_anti")


def manifest(expected: DataFrame, produced: DataFrame, key: str = "artifact") -> DataFrame:
    """Every expected artifact with its row count, and whether it exists."""
    counts = produced.groupBy(key).agg(F.count("*").alias("n_rows"))
    return expected.join(counts, key, "left").select(
        key, F.col("n_rows").isNotNull().alias("present"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows")
    )


def assert_complete(expected: DataFrame, produced: DataFrame, key: str = "artifact") -> None:
    gone = missing_artifacts(expected, produced, key)
    if not gone.isEmpty():
        raise ValueError(f"missing artifacts, first: {gone.first()[key]}")
