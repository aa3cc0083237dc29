"""Joins of irregular time data.

None of them compares every row with every row: intervals, tolerances and
nearest boundaries are turned into equality on a coarse key first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
#: Samples of one entity and hour that one task joins as they are.
CROWD = 1 << 16


def crowded_hours(samples: DataFrame, entity: str, at: str, bucket_us: int, salts: int) -> DataFrame:
    """(entity, hour) of more than ``CROWD`` samples and how many tasks they are spread over: one row per ``CROWD`` samples at most."""
    hour = F.floor(F.col(at) / bucket_us).alias("_h")
    return samples.groupBy(entity, hour).agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD).select(entity, "_h", F.lit(salts).alias("_salts"))


def listed_hours(periods: DataFrame, crowded: DataFrame, entity: str, start: str, end: str, bucket_us: int) -> DataFrame:
    """A period once per hour it touches, and per salt of a crowded hour."""
    hours = F.sequence(F.floor(F.col(start) / bucket_us), F.floor(F.col(end) / bucket_us))
    right = periods.withColumn("_h", F.explode(hours)).join(F.broadcast(crowded), [entity, "_h"], "left")
    return right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1).cast("array<bigint>"))).drop("_salts")


def interval_join(
    samples: DataFrame, periods: DataFrame, entity: str = "entity_id", at: str = "at_us",
    start: str = "start_us", end: str = "end_us", bucket_us: int = HOUR_US, salts: int = 8,
) -> DataFrame:
    """Samples inside ``[start, end]`` of a period of the same entity.

    A period is listed once per hour it touches, so the join is an equality on
    (entity, hour).  ``salts`` spreads the samples of a hot entity-hour over that
    many tasks; only there the period side is repeated for it.
    """
    crowded = crowded_hours(samples, entity, at, bucket_us, salts)
    left = samples.withColumn("_h", F.floor(F.col(at) / bucket_us)).join(F.broadcast(crowded), [entity, "_h"], "left")
    left = left.withColumn("_s", F.pmod(F.xxhash64(at), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    right = listed_hours(periods, crowded, entity, start, end, bucket_us)
    return left.join(right, [entity, "_h", "_s"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_h", "_s")


def epoch_of(at: Column, start: Column, width_us: int = 300_000_000) -> Column:
    """Index of the fixed-width epoch that holds an instant."""
    return F.floor((at - start) / F.lit(width_us)).cast("bigint")


def epoch_lookup(
    samples: DataFrame, epochs: DataFrame, period: str = "period_id", at: str = "at_us", start: str = "start_us",
    index: str = "epoch_index", width_us: int = 300_000_000, salts: int = 8,
) -> DataFrame:
    """Attach the epoch row an in-period sample falls into (equality on period and index, salted)."""
    left = samples.withColumn(index, epoch_of(F.col(at), F.col(start), width_us)).withColumn("_s", F.pmod(F.xxhash64(at), F.lit(salts)))
    right = epochs.withColumn(index, F.col(index).cast("bigint")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return left.join(right, [period, index, "_s"]).drop("_s")


def slot_ratio_join(slots: DataFrame, epochs: DataFrame, period: str, slot: str, index: str, ratio: int = 10) -> DataFrame:
    """Fine slot i belongs to coarse epoch ``min(i // ratio, last)``."""
    last = epochs.groupBy(period).agg((F.count("*") - 1).alias("_last"))
    left = slots.join(last, period).withColumn(index, F.least(F.floor(F.col(slot) / ratio), F.col("_last")).cast("bigint")).drop("_last")
    return left.join(epochs.withColumn(index, F.col(index).cast("bigint")), [period, index])


def tolerance_join(left: DataFrame, right: DataFrame, by: Sequence[str], k: int, day: str = "day", other_day: str = "other_day") -> DataFrame:
    """Rows of ``right`` at most k days from a row of ``left``: the left days fan out to 2k+1 equality keys."""
    fan = left.withColumn("_off", F.explode(F.sequence(F.lit(-k), F.lit(k)))).withColumn(other_day, F.date_add(day, F.col("_off")))
    return fan.join(right.withColumnRenamed(day, other_day), [*by, other_day]).withColumnRenamed("_off", "offset_days")


def nearest_in_time(left: DataFrame, right: DataFrame, by: Sequence[str], k: int, value: str, day: str = "day") -> DataFrame:
    """Closest right row within k days per left row; earlier one on a tie."""
    pairs = tolerance_join(left, right, by, k, day)
    rank = F.struct(F.abs("offset_days"), F.col("offset_days"))
    return pairs.groupBy(*by, day).agg(F.min_by(F.struct("other_day", value, "offset_days"), rank).alias("_m")).select(*by, day, "_m.*")


def nearest_boundary(days: DataFrame, boundaries: DataFrame, by: Sequence[str], day: str = "day") -> DataFrame:
    """Distance to and kind of the nearest boundary day, looking both ways.

    Boundaries (``day``, ``kind``) and days are ordered together once per entity;
    the last boundary behind and the first ahead are carried along.
    """
    both = days.select(*by, day, F.lit(None).cast("string").alias("kind"), F.lit(0).alias("_b")).unionAll(
        boundaries.select(*by, day, "kind", F.lit(1).alias("_b"))
    )
    mark = F.when(F.col("_b") == 1, F.struct(F.col(day).alias("d"), F.col("kind").alias("k")))
    w = Window.partitionBy(*by)
    behind = F.last(mark, ignorenulls=True).over(w.orderBy(F.col(day), F.desc("_b"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(mark, ignorenulls=True).over(w.orderBy(F.col(day), F.col("_b"), F.col("kind")).rowsBetween(0, Window.unboundedFollowing))
    d = both.withColumn("_p", behind).withColumn("_n", ahead).where("_b = 0")
    back, front = F.datediff(day, F.col("_p.d")), F.datediff(F.col("_n.d"), F.col(day))
    use_back = front.isNull() | (back <= front)
    return d.select(
        *by, day, F.when(use_back, back).otherwise(front).cast("bigint").alias("distance_days"),
        F.when(use_back, F.col("_p.k")).otherwise(F.col("_n.k")).alias("boundary"),
    )


def wear_gaps(days: DataFrame, by: Sequence[str], day: str = "day", min_gap: int = 3) -> DataFrame:
    """Holes of more than ``min_gap`` days as (gap_start, gap_end): last day before, first day after."""
    w = Window.partitionBy(*by).orderBy(day)
    d = days.select(*by, day).withColumn("gap_start", F.lag(day).over(w))
    return d.where(F.datediff(day, "gap_start") > min_gap).select(*by, "gap_start", F.col(day).alias("gap_end"))


def gap_boundaries(gaps: DataFrame, by: Sequence[str]) -> DataFrame:
    pairs = F.array(
        F.struct(F.col("gap_start").alias("day"), F.lit("gap_start").alias("kind")),
        F.struct(F.col("gap_end").alias("day"), F.lit("gap_end").alias("kind")),
    )
    return gaps.select(*by, F.inline(pairs))


def lag_pairs_rows(df: DataFrame, x: str, y: str, by: Sequence[str], lag: int, day: str = "day") -> DataFrame:
    """x(t) beside y of the row ``lag`` rows later (rows, so gaps stretch the lag)."""
    w = Window.partitionBy(*by).orderBy(day)
    later = F.lead(y, lag).over(w) if lag >= 0 else F.lag(y, -lag).over(w)
    return df.select(*by, day, F.col(x).alias("x"), later.alias("y"))


def lag_pairs_days(df: DataFrame, x: str, y: str, by: Sequence[str], lag: int, day: str = "day") -> DataFrame:
    """x(t) beside y exactly ``lag`` calendar days later."""
    later = df.select(*by, F.date_sub(day, F.lit(lag)).alias(day), F.col(y).alias("y"))
    return df.select(*by, day, F.col(x).alias("x")).join(later, [*by, day], "left")


def enrich(rows: DataFrame, daily: DataFrame, columns: Sequence[str], by: Sequence[str] = ("entity_id", "day")) -> DataFrame:
    """Values of the same day beside each (anomaly) row."""
    return rows.join(daily.select(*by, *columns), list(by), "left")


def fill_from(primary: DataFrame, secondary: DataFrame, column: str, by: Sequence[str] = ("entity_id", "day")) -> DataFrame:
    """NULLs of one column taken from a second table."""
    other = secondary.select(*by, F.col(column).alias("_o"))
    return primary.join(other, list(by), "left").withColumn(column, F.coalesce(column, "_o")).drop("_o")


def small_dimension(facts: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join to a registry; Spark broadcasts it while its measured size is below the session's limit."""
    return facts.join(dimension, list(on), "left")
