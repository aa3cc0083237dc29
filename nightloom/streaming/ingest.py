"""Incremental loads: overlap-safe ingest, upserts, windows, sessions, enrichment, quality gate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import split_valid
from ..session import scratch_path
from ..sources import sinks


def file_stream(spark: SparkSession, path: str, pattern: str | None = None, files_per_trigger: int | None = None, schema: str | None = None) -> DataFrame:
    """Parquet files of a folder (those matching ``pattern``) as a stream.

    Zone-less stamps become instants, which watermarks need.
    """
    shape = schema or spark.read.parquet(f"{path}/{pattern}" if pattern else path).schema
    reader = spark.readStream.schema(shape)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(path)
    return df.select(*[F.col(n).cast("timestamp").alias(n) if t == "timestamp_ntz" else F.col(n) for n, t in df.dtypes])


def sample_stream(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", F.col("user_id").alias("entity_id"), F.col("event_type").alias("metric"), "ts", "value",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


def dedup(stream: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "3 days") -> DataFrame:
    """First arrival per key within the overlap window; state is dropped behind the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling(stream: DataFrame, by: Sequence[str], width: str = "1 hour", value: str = "value", ts: str = "ts", delay: str = "3 days", slide: str | None = None, min_count: int = 1, sums: Sequence[str] = ()) -> DataFrame:
    """Window means in append mode, and totals of the columns in ``sums``: a window is final once the watermark passes it."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = stream.withWatermark(ts, delay).groupBy(*by, w).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *[F.sum(c).alias(c) for c in sums])
    return g.where(F.col("n") >= min_count).select(*by, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "mean", *sums)


def sessions(stream: DataFrame, by: Sequence[str], gap: str = "30 minutes", ts: str = "ts", delay: str = "3 days", min_rows: int = 2, sums: Sequence[str] = ()) -> DataFrame:
    """Gap-based groups with their count, bounds and totals of the columns in ``sums``.

    Each task merges the samples it holds into sessions before the exchange, so a hot entity sends a summary for each
    session and task, not its samples; the setting that asks for it is read when the query starts.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    g = stream.withWatermark(ts, delay).groupBy(*by, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), *[F.sum(c).alias(c) for c in sums])
    return g.where(F.col("n") >= min_rows).drop("session_window")


def enrich(stream: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Stream joined to a static registry; Spark broadcasts it while it is small."""
    return stream.join(dimension, list(on), "left")


def run_available(stream: DataFrame, name: str, mode: str = "append", partition_by: Sequence[str] = ()) -> DataFrame:
    """Process what is there, then read the written table back."""
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    writer = stream.writeStream.format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/progress").outputMode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def run_batches(stream: DataFrame, name: str, apply: Callable[[DataFrame, int], None]) -> str:
    """``foreachBatch`` over what is there; returns the job's folder."""
    root = scratch_path(stream.sparkSession, name)
    stream.writeStream.option("checkpointLocation", f"{root}/progress").foreachBatch(apply).trigger(availableNow=True).start().awaitTermination()
    return root


def upsert_stream(stream: DataFrame, name: str, keys: Sequence[str], order: Sequence[str | Column], month_of: str = "day") -> DataFrame:
    """Late daily rows replace earlier ones: each micro-batch rewrites only the months it touches.

    A retried batch gives the same table, because the newest row per key wins again.
    """
    spark = stream.sparkSession
    target = scratch_path(spark, f"{name}-table")

    def merge(batch: DataFrame, _: int) -> None:
        sinks.merge_into(batch.sparkSession, target, batch.withColumn("month", F.date_format(month_of, "yyyy-MM")), keys, order)

    run_batches(stream, name, merge)
    return spark.read.parquet(target)


def quality_stream(stream: DataFrame, name: str, ranges: dict) -> tuple[DataFrame, DataFrame]:
    """Rows inside their ranges and quarantined rows, written per batch under the batch's own folder
    so that a retry overwrites instead of doubling."""
    spark = stream.sparkSession
    target = scratch_path(spark, f"{name}-gate")

    def gate(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        good, bad = split_valid(batch, ranges)
        good.write.mode("overwrite").parquet(f"{target}/valid/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{target}/quarantine/batch={batch_id}")
        batch.unpersist()

    run_batches(stream, name, gate)
    read = lambda part: spark.read.parquet(f"{target}/{part}").drop("batch")
    return read("valid"), read("quarantine")
