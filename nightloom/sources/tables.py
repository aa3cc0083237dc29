"""Table scans: pruned, filtered, bounded and checked."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import convert


def scan(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, not_null: Iterable[str] = (),
    positive: Iterable[str] = (), where: Column | None = None, schema: str | None = None,
) -> DataFrame:
    """Parquet scan whose projection and predicates reach the reader."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    for c in not_null:
        df = df.where(F.col(c).isNotNull())
    for c in positive:
        df = df.where(F.col(c) > 0)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def declared(df: DataFrame, layout: str) -> DataFrame:
    """Bring a frame to a declared layout; columns it lacks are NULL of the declared type."""
    have, out = set(df.columns), []
    for field in layout.split(","):
        name, kind = field.strip().split(" ", 1)
        out.append((F.col(name) if name in have else F.lit(None)).try_cast(kind).alias(name))
    return df.select(*out)


def between_days(df: DataFrame, first, last, day: str = "day") -> DataFrame:
    return df.where(F.col(day).between(F.lit(first), F.lit(last)))


def from_day(df: DataFrame, first, day: str = "day") -> DataFrame:
    return df.where(F.col(day) >= F.lit(first))


def long_periods(df: DataFrame, kind: str = "long_sleep") -> DataFrame:
    return df.where(F.col("type") == kind)


def by_source(df: DataFrame, pattern: str) -> DataFrame:
    """``rest``, ``awake`` or a LIKE pattern such as ``sleep_period:%``."""
    c = F.col("source")
    return df.where(c.like(pattern) if "%" in pattern else c == pattern)


def to_signals(df: DataFrame, metrics: dict[str, str | Column], entity: str = "entity_id", day: str = "day") -> DataFrame:
    """Wide daily columns to long (entity, day, metric, value), NULLs dropped."""
    pairs = [F.struct(F.lit(m).alias("metric"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("value")) for m, c in metrics.items()]
    return df.select(entity, day, F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def load_metric(df: DataFrame, metric_defs: DataFrame) -> DataFrame:
    """Registry-driven units: long signals joined to the metric registry (Spark broadcasts it while it is small)."""
    return df.join(metric_defs, "metric").withColumn("value", convert("value", "transform"))


def observed_range(frames: dict[str, DataFrame], day: str = "day") -> DataFrame:
    """First and last day over several tables: each table shrinks to one row before the union."""
    parts = [
        f.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")).withColumn("source", F.lit(n))
        for n, f in frames.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("source", "first_day", "last_day")


def latest_day(frames: dict[str, DataFrame], day: str = "day") -> DataFrame:
    return observed_range(frames, day).agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def read_metrics_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read back module results; unreadable lines are kept out."""
    return (
        spark.read.schema(schema + ", _bad STRING").option("columnNameOfCorruptRecord", "_bad")
        .json(path).where(F.col("_bad").isNull()).drop("_bad")
    )


def jdbc_table(spark: SparkSession, url: str, table: str, column: str, low: str, high: str, parts: int, **options: str) -> DataFrame:
    """Partitioned read for samples that stay in a database."""
    return (
        spark.read.format("jdbc").option("url", url).option("dbtable", table)
        .option("partitionColumn", column).option("lowerBound", low).option("upperBound", high)
        .option("numPartitions", parts).options(**options).load()
    )


def precheck(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """One row per required table: readable, and not empty."""
    rows = []
    for name, path in tables.items():
        try:
            rows.append((name, True, not spark.read.parquet(path).isEmpty()))
        except Exception:  # a missing or broken table is a finding, not a crash
            rows.append((name, False, False))
    return spark.createDataFrame(rows, "table STRING, readable BOOLEAN, has_rows BOOLEAN")
