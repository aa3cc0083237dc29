"""Gap repair, sessions and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_us


def calendar_spine(df: DataFrame, by: Sequence[str], day: str = "day") -> DataFrame:
    """Every day between the first and last observation of each entity."""
    span = df.groupBy(*by).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    return span.select(*by, F.explode(F.sequence("_a", "_b")).alias(day))


def on_calendar(df: DataFrame, by: Sequence[str], day: str = "day") -> DataFrame:
    """Missing days become rows with NULL measurements."""
    return calendar_spine(df, by, day).join(df, [*by, day], "left")


def interpolate(df: DataFrame, value: str, by: Sequence[str], day: str = "day", limit: int | None = 3, out: str = "filled") -> DataFrame:
    """Linear repair on a regular calendar.

    At most ``limit`` missing rows next to each known neighbour are filled (both
    directions); ends without a neighbour on one side take the nearest value
    within the limit.
    """
    w = Window.partitionBy(*by).orderBy(day)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col(value).isNotNull(), F.unix_date(day))
    d = (
        df.withColumn("_v0", F.last(value, ignorenulls=True).over(back)).withColumn("_d0", F.last(seen, ignorenulls=True).over(back))
        .withColumn("_v1", F.first(value, ignorenulls=True).over(ahead)).withColumn("_d1", F.first(seen, ignorenulls=True).over(ahead))
    )
    pos, d0, d1 = F.unix_date(day), F.col("_d0"), F.col("_d1")
    near = F.lit(True) if limit is None else (
        F.coalesce(pos - d0 <= limit, F.lit(False)) | F.coalesce(d1 - pos <= limit, F.lit(False))
    )
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (pos - d0) / (d1 - d0)
    guess = F.coalesce(line, F.col("_v0"), F.col("_v1"))
    return d.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(near, guess)).drop("_v0", "_d0", "_v1", "_d1")


def carry(df: DataFrame, value: str, by: Sequence[str], day: str = "day", out: str = "filled") -> DataFrame:
    """Last known value forward, then the first known value backward."""
    w = Window.partitionBy(*by).orderBy(day)
    fwd = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    bwd = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(fwd, bwd))


def gap_sessions(samples: DataFrame, by: Sequence[str], ts: str = "ts", gap_s: int = 1800, min_rows: int = 2, sums: dict[str, Column] | None = None) -> DataFrame:
    """Groups of samples no more than ``gap_s`` apart: one row per session.

    Samples first collapse into slots of width ``gap_s``: two samples of one slot
    are never further apart than the gap, so a slot lies in one session.  Only
    slot summaries are ordered, and there are as many of them as the calendar
    has slots, however many samples an entity sends.
    """
    width = gap_s * 1_000_000
    extra = {k: F.sum(c).alias(k) for k, c in (sums or {}).items()}
    slots = (
        samples.where(F.col(ts).isNotNull()).withColumn("_us", epoch_us(ts))
        .withColumn("_slot", F.floor(F.col("_us") / width))
        .groupBy(*by, "_slot")
        .agg(F.min("_us").alias("_a"), F.max("_us").alias("_b"), F.count("*").alias("_n"), *extra.values())
    )
    w = Window.partitionBy(*by).orderBy("_slot")
    starts = F.when(F.col("_a") - F.lag("_b").over(w) > width, 1).otherwise(0)
    marked = slots.withColumn("_new", starts).withColumn("session", F.sum("_new").over(w))
    return (
        marked.groupBy(*by, "session")
        .agg(F.min("_a").alias("start_us"), F.max("_b").alias("end_us"), F.sum("_n").alias("n"), *[F.sum(k).alias(k) for k in extra])
        .where(F.col("n") >= min_rows)
    )


def runs(df: DataFrame, condition: Column, by: Sequence[str], day: str = "day", max_gap_days: int | None = None) -> DataFrame:
    """Consecutive rows where the condition holds: start, end, length."""
    w = Window.partitionBy(*by).orderBy(day)
    d = df.withColumn("_hit", F.coalesce(condition, F.lit(False))).withColumn("_prev", F.lag("_hit").over(w))
    fresh = ~F.coalesce(F.col("_prev"), F.lit(False))
    if max_gap_days is not None:
        fresh = fresh | (F.datediff(day, F.lag(day).over(w)) > max_gap_days)
    d = d.withColumn("_new", F.when(F.col("_hit") & fresh, 1).otherwise(0)).withColumn("run", F.sum("_new").over(w))
    return d.where("_hit").groupBy(*by, "run").agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count("*").alias("n"))


def islands(df: DataFrame, by: Sequence[str], day: str = "day", tolerance: int = 3) -> DataFrame:
    """Cluster id of dates whose neighbours lie at most ``tolerance`` days apart."""
    w = Window.partitionBy(*by).orderBy(day)
    jump = F.when(F.datediff(day, F.lag(day).over(w)) > tolerance, 1).otherwise(0)
    return df.withColumn("_j", jump).withColumn("island", F.sum("_j").over(w)).drop("_j")
