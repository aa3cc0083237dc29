"""Windows over daily series.

Frames are rows of one entity's (metric's) daily series.  After the daily
pre-aggregation such a series has at most one row per calendar day, so the
partition of any window below is bounded by the calendar, not by data volume.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def series(by: Sequence[str], day: str = "day") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(day)


def trailing(by: Sequence[str], n: int, day: str = "day", mode: str = "rows") -> WindowSpec:
    """Last n rows, or with ``mode="days"`` last n calendar days."""
    if mode == "rows":
        return series(by, day).rowsBetween(-(n - 1), 0)
    return Window.partitionBy(*by).orderBy(F.unix_date(day)).rangeBetween(-(n - 1), 0)


def centred(by: Sequence[str], half: int, day: str = "day") -> WindowSpec:
    return series(by, day).rowsBetween(-half, half)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at_least(k: int, value: Column | str, w: WindowSpec, stat: Column) -> Column:
    """The statistic where the frame holds at least k values, else NULL."""
    return F.when(F.count(_c(value)).over(w) >= k, stat)


def roll_mean(value: Column | str, w: WindowSpec, min_periods: int = 1) -> Column:
    return at_least(min_periods, value, w, F.avg(_c(value)).over(w))


def roll_sd(value: Column | str, w: WindowSpec, min_periods: int = 2) -> Column:
    return at_least(max(min_periods, 2), value, w, F.stddev_samp(_c(value)).over(w))


def roll_cv(value: Column | str, w: WindowSpec, min_periods: int = 2) -> Column:
    return roll_sd(value, w, min_periods) / F.nullif(F.abs(F.avg(_c(value)).over(w)), F.lit(0.0)) * 100


def roll_sum(value: Column | str, w: WindowSpec) -> Column:
    return F.sum(_c(value)).over(w)


def roll_slope(value: str, position: str, w: WindowSpec, n: int, min_periods: int = 3) -> Column:
    """Least-squares slope over position, only for full frames of n rows."""
    return F.when(F.count("*").over(w) == n, at_least(min_periods, value, w, F.regr_slope(_c(value), _c(position)).over(w)))


def roll_corr(x: str, y: str, w: WindowSpec, n: int) -> Column:
    """Pearson over full frames of pairs; NULL where either side does not vary."""
    both = _c(x).isNotNull() & _c(y).isNotNull()
    a, b = F.when(both, _c(x)), F.when(both, _c(y))
    vary = (F.stddev_pop(a).over(w) > 1e-12) & (F.stddev_pop(b).over(w) > 1e-12)
    return F.when((F.count(a).over(w) == n) & vary, pearson(a, b, w))


def pearson(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Correlation from population moments; NULL without variation (``corr`` fails on it in ANSI mode)."""
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    run = (lambda c: c) if over is None else (lambda c: c.over(over))
    scale = run(F.stddev_pop(a)) * run(F.stddev_pop(b))
    return run(F.covar_pop(a, b)) / F.when(scale > 1e-300, scale)


def unit_sd(sd: Column) -> Column:
    """A missing or zero spread counts as 1."""
    return F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)


def z_score(value: str, by: Sequence[str], baseline: Column | None = None, population: bool = False) -> Column:
    """Deviation from the own (baseline) mean in own standard deviations."""
    w = Window.partitionBy(*by)
    base = _c(value) if baseline is None else F.when(baseline, _c(value))
    spread = F.stddev_pop if population else F.stddev_samp
    return (_c(value) - F.avg(base).over(w)) / unit_sd(spread(base).over(w))


def in_days(first: date, last: date, day: str = "day") -> Column:
    return F.col(day).between(F.lit(first), F.lit(last))


def first_rows(by: Sequence[str], k: int, day: str = "day") -> Column:
    return F.row_number().over(series(by, day)) <= k


def last_rows(by: Sequence[str], k: int, day: str = "day") -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col(day).desc())) <= k


def first_half(by: Sequence[str], day: str = "day") -> Column:
    return F.row_number().over(series(by, day)) <= F.floor(F.count("*").over(Window.partitionBy(*by)) / 2)


def step_change(value: str, by: Sequence[str], k: int = 1, day: str = "day") -> Column:
    return _c(value) - F.lag(value, k).over(series(by, day))


def rolling_band(df: DataFrame, value: str, by: Sequence[str], n: int = 7, min_periods: int = 3) -> DataFrame:
    w = trailing(by, n)
    mean, sd = roll_mean(value, w, min_periods), roll_sd(value, w, min_periods)
    return df.withColumn("mean", mean).withColumn("lower", F.col("mean") - sd).withColumn("upper", F.col("mean") + sd)


def split_half_flags(df: DataFrame, value: str, by: Sequence[str], flag: Column) -> DataFrame:
    """Rate and spread of the second half against the first: x1.5 and x1.3 raise the flags."""
    early = first_half(by)
    d = df.withColumn("_early", early).withColumn("_flag", flag.cast("double"))
    g = d.groupBy(*by).agg(
        F.avg(F.when(F.col("_early"), F.col("_flag"))).alias("rate_first"),
        F.avg(F.when(~F.col("_early"), F.col("_flag"))).alias("rate_second"),
        F.stddev_samp(F.when(F.col("_early"), F.col(value))).alias("sd_first"),
        F.stddev_samp(F.when(~F.col("_early"), F.col(value))).alias("sd_second"),
    )
    return g.withColumn("rate_up", F.col("rate_second") > F.col("rate_first") * 1.5).withColumn(
        "spread_up", F.col("sd_second") > F.col("sd_first") * 1.3
    )


def ensemble_rank(df: DataFrame, score: str, by: Sequence[str], share: float = 0.9) -> DataFrame:
    """Rank (ties share the smallest) and top-decile flag inside one entity's days."""
    w = Window.partitionBy(*by)
    cut = F.percentile(score, F.lit(share)).over(w)
    return df.withColumn("rank", F.rank().over(w.orderBy(F.col(score).desc()))).withColumn("anomalous", F.col(score) >= cut)
