"""Daily frames: aggregates, profiles, pivots and calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import histogram_quantiles
from ..functions.scalar import epoch_us, night_hour


def daily_stats(samples: DataFrame, by: Sequence[str], value: str = "value", cents: str = "cents") -> DataFrame:
    """Mean, sd, min, max, median and count per key and day from raw samples.

    The samples collapse to (key, reading, count) once; both the moments and the
    exact median come from that histogram, so a busy key combines map-side.
    """
    n, v = F.col("_n"), F.col(value)
    hist = samples.groupBy(*by, value).agg(F.count("*").alias("_n"), F.sum(cents).alias("_c"))
    mean = F.sum("_c").cast("double") / F.sum("_n") / 100
    first = hist.groupBy(*by).agg(
        F.sum("_n").alias("n"), mean.alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.percentile(value, F.lit(0.5), F.col("_n")).alias("median"),
        F.sum(n * v).alias("_s"), F.sum(n * v * v).alias("_q"),
    )
    spread = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / F.col("n"), F.lit(0.0))
    return first.withColumn("sd", F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1)))).drop("_s", "_q")


def day_means(samples: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return samples.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def describe(signals: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Standard block per series (one value per day, so the exact percentiles are calendar-bounded)."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = signals.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("low"), F.max(value).alias("high"), q.alias("_q"),
        F.skewness(value).alias("skew"), F.stddev_pop(value).alias("sd_pop"),
    )
    return g.withColumn("median", F.col("_q")[1]).withColumn("iqr", F.col("_q")[2] - F.col("_q")[0]).drop("_q")


def resting_level(samples: DataFrame, by: Sequence[str], value: str, share: float = 0.10) -> DataFrame:
    """Low percentile of a day's readings, e.g. a resting heart rate."""
    return histogram_quantiles(samples, by, value, {"resting": share})


def hour_profile(samples: DataFrame, by: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    return samples.groupBy(*by, F.hour(ts).alias("hour")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def night_profile(samples: DataFrame, by: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    d = samples.withColumn("night_hour", night_hour(ts)).where("night_hour IS NOT NULL")
    return d.groupBy(*by, "night_hour").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def hourly_bins(samples: DataFrame, by: Sequence[str], value: str = "value", ts: str = "ts", min_count: int = 3) -> DataFrame:
    """Hourly means; thin hours are dropped."""
    hour = F.floor(epoch_us(ts) / F.lit(3_600_000_000))
    return samples.groupBy(*by, hour.alias("hour_no")).agg(F.count("*").alias("n"), F.avg(value).alias("value")).where(F.col("n") >= min_count)


def widen(signals: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("entity_id", "day")) -> DataFrame:
    """Long to wide with a declared column list: one shuffle instead of a chain of joins."""
    return signals.groupBy(*by).pivot("metric", list(metrics)).agg(F.first("value"))


def day_universe(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0].distinct()
    for f in frames[1:]:
        out = out.union(f.distinct())
    return out.distinct()


def overlap_days(signals: DataFrame, entity: str = "entity_id", day: str = "day") -> DataFrame:
    """Days on which every entity has data."""
    pairs = signals.select(entity, day).distinct()
    everyone = pairs.agg(F.count_distinct(entity).alias("_k"))
    per_day = pairs.groupBy(day).agg(F.count("*").alias("_n"))
    return per_day.where(F.col("_n") == everyone.scalar()).select(day)


def differences(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys only in the old and only in the new frame, from one pass over both."""
    both = old.select(*keys, F.lit(1).alias("_o"), F.lit(0).alias("_n")).unionAll(new.select(*keys, F.lit(0).alias("_o"), F.lit(1).alias("_n")))
    g = both.groupBy(*keys).agg(F.max("_o").alias("_o"), F.max("_n").alias("_n")).where(F.col("_o") != F.col("_n"))
    return g.select(*keys, F.when(F.col("_o") == 1, "gone").otherwise("new").alias("side"))


def summary_line(df: DataFrame, source: str, value: Column, threshold: float) -> DataFrame:
    """One row of headline numbers of one table."""
    return df.agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("high"),
        F.count_if(value > threshold).alias("n_above"), F.bool_and(value > 0).alias("all_positive"),
    ).select(F.lit(source).alias("source"), "*")


def histogram(df: DataFrame, by: Sequence[str], value: str, width: float) -> DataFrame:
    return df.groupBy(*by, F.floor(F.col(value) / F.lit(width)).alias("bin")).agg(F.count("*").alias("n")).withColumn("left_edge", F.col("bin") * width)


def density_2d(df: DataFrame, by: Sequence[str], x: str, y: str, width: float) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        *by, F.floor(F.col(x) / width).alias("x_bin"), F.floor(F.col(y) / width).alias("y_bin")
    ).agg(F.count("*").alias("n"))


def calendar_heatmap(signals: DataFrame, by: Sequence[str], value: str = "value", day: str = "day") -> DataFrame:
    return signals.groupBy(*by, F.weekday(day).alias("weekday"), F.weekofyear(day).alias("week")).agg(F.avg(value).alias("value"))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Best k rows per group; Spark limits each map task to k rows per group before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
