"""Control charts and sequential rules on daily series (calendar-bounded)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import series

# Chart parameters.
BASELINE_ROWS = 14
WARN_SIGMA, ACTION_SIGMA = 2, 3
CUSUM_K, CUSUM_H = 0.5, 4.0
EWMA_LAMBDA = 0.2
RED_PRE, RED_ACTIVE = 0.50, 0.20
YELLOW_PRE, YELLOW_RUN = 0.30, 3


def with_baseline(df: DataFrame, value: str, by: Sequence[str], rows: int = BASELINE_ROWS, day: str = "day") -> DataFrame:
    """Row number, and mean and population sd of the first rows of the own series."""
    d = df.where(F.col(value).isNotNull()).withColumn("rn", F.row_number().over(series(by, day)))
    w = Window.partitionBy(*by)
    base = F.when(F.col("rn") <= rows, F.col(value))
    sd = F.stddev_pop(base).over(w)
    return d.withColumn("mu", F.avg(base).over(w)).withColumn("sigma", F.when(sd < 1e-10, 1.0).otherwise(sd))


def one_sided(z: Column, limit: float, direction: str | Column) -> Column:
    side = F.lit(direction) if isinstance(direction, str) else direction
    return F.when(side == "upper", z > limit).when(side == "lower", z < -limit).otherwise(F.abs(z) > limit)


def shewhart(df: DataFrame, value: str, by: Sequence[str], direction: str | Column = "both") -> DataFrame:
    z = (F.col(value) - F.col("mu")) / F.col("sigma")
    return (
        with_baseline(df, value, by).withColumn("z", z)
        .withColumn("warn", one_sided(F.col("z"), WARN_SIGMA, direction))
        .withColumn("action", one_sided(F.col("z"), ACTION_SIGMA, direction))
    )


def cusum(df: DataFrame, value: str, by: Sequence[str], k: float = CUSUM_K, h: float = CUSUM_H, day: str = "day") -> DataFrame:
    """Two-sided CUSUM without a recursion: ``max(0, s + d)`` equals the running
    sum minus its running minimum (the chart starts at 0 on the first row)."""
    w = series(by, day).rowsBetween(Window.unboundedPreceding, 0)
    d = with_baseline(df, value, by, day=day)
    later = F.col("rn") > 1
    up = F.when(later, F.col(value) - F.col("mu") - k * F.col("sigma")).otherwise(0.0)
    down = F.when(later, F.col("mu") - F.col(value) - k * F.col("sigma")).otherwise(0.0)
    d = d.withColumn("_u", F.sum(up).over(w)).withColumn("_d", F.sum(down).over(w))
    d = d.withColumn("cusum_pos", F.col("_u") - F.least(F.min("_u").over(w), F.lit(0.0))).withColumn(
        "cusum_neg", F.col("_d") - F.least(F.min("_d").over(w), F.lit(0.0))
    )
    limit = h * F.col("sigma")
    return d.withColumn("alarm", (F.col("cusum_pos") > limit) | (F.col("cusum_neg") > limit)).drop("_u", "_d")


def cusum_reset(df: DataFrame, value: str, by: Sequence[str], k: float = 0.5, h: float = 4.0, day: str = "day") -> DataFrame:
    """CUSUM that starts over after each alarm: one row per regime change.

    The reset makes the state depend on its own alarms, so the ordered series
    (one value per day) is folded once; only alarm days are kept.
    """
    w = Window.partitionBy(*by)
    d = df.where(F.col(value).isNotNull()).withColumn("rn", F.row_number().over(series(by, day)))
    base = F.when(F.col("rn") <= BASELINE_ROWS, F.col(value))
    raw = F.stddev_pop(base).over(w)
    d = d.withColumn("_mu", F.avg(base).over(w)).withColumn("_sd", F.when(raw > 0.01, raw).otherwise(0.1))
    d = d.withColumn("_x", F.when(F.col("rn") > 1, (F.col(value) - F.col("_mu")) / F.col("_sd")).otherwise(0.0))
    path = d.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rn", F.col(day).alias("d"), "_x"))).alias("p"))
    start = F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.array().cast("array<date>").alias("alarms"))

    def step(acc: Column, row: Column) -> Column:
        shift = F.when(row["rn"] > 1, F.lit(k)).otherwise(0.0)
        pos = F.greatest(F.lit(0.0), acc["pos"] + row["_x"] - shift)
        neg = F.greatest(F.lit(0.0), acc["neg"] - row["_x"] - shift)
        hit = (pos > h) | (neg > h)
        return F.struct(
            F.when(hit, 0.0).otherwise(pos).alias("pos"), F.when(hit, 0.0).otherwise(neg).alias("neg"),
            F.when(hit, F.array_append(acc["alarms"], row["d"])).otherwise(acc["alarms"]).alias("alarms"),
        )

    return path.select(*by, F.explode(F.aggregate("p", start, step)["alarms"]).alias(day))


def ewma(df: DataFrame, value: str, by: Sequence[str], lam: float = EWMA_LAMBDA, direction: str | Column = "both", day: str = "day") -> DataFrame:
    """Exponentially weighted mean with widening limits.

    Weights older than the frame are below 1e-16, so a bounded frame gives the
    recursion's value to double precision in a single window.
    """
    depth = math.ceil(math.log(1e-16) / math.log(1 - lam))
    w = series(by, day).rowsBetween(-(depth - 1), 0)
    d = with_baseline(df, value, by, day=day)
    recent = F.collect_list(value).over(w)
    d = d.withColumn("_r", recent).withColumn(
        "ewma", F.aggregate(F.slice("_r", 2, depth), F.element_at("_r", 1), lambda a, x: lam * x + (1 - lam) * a)
    )
    spread = F.col("sigma") * F.sqrt(F.lit(lam / (2 - lam)) * (1 - F.pow(F.lit(1 - lam), 2 * F.col("rn"))))
    d = d.withColumn("ucl", F.col("mu") + ACTION_SIGMA * spread).withColumn("lcl", F.col("mu") - ACTION_SIGMA * spread).drop("_r")
    side = F.lit(direction) if isinstance(direction, str) else direction
    high, low = F.col("ewma") > F.col("ucl"), F.col("ewma") < F.col("lcl")
    return d.withColumn("violation", F.when(side == "upper", high).when(side == "lower", low).otherwise(high | low))


def daily_score(charted: DataFrame, by: Sequence[str] = ("entity_id", "day")) -> DataFrame:
    """Worst metric of the day in units of the action limit, capped at 1.5."""
    return charted.groupBy(*by).agg(F.max(F.least(F.abs("z") / ACTION_SIGMA, F.lit(1.5))).alias("score"))


def rolling_shift(df: DataFrame, value: str, by: Sequence[str], window: int = 14, day: str = "day") -> DataFrame:
    """Welch t and pooled d of the rows before against the rows from each point on.

    Only points with full windows on both sides are kept, the last ``window``
    rows excluded.
    """
    w = series(by, day)
    before, after = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
    c = F.col(value)
    d = df.where(c.isNotNull()).withColumn("rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    d = (
        d.withColumn("m0", F.avg(c).over(before)).withColumn("v0", F.var_samp(c).over(before))
        .withColumn("m1", F.avg(c).over(after)).withColumn("v1", F.var_samp(c).over(after))
        .where((F.col("rn") > window) & (F.col("rn") <= F.col("_n") - window) & (F.col("_n") >= 2 * window + 2))
    )
    se2 = (F.col("v0") + F.col("v1")) / window
    pooled = F.sqrt((F.col("v0") + F.col("v1")) / 2)
    dof = (window - 1) * F.pow(F.col("v0") + F.col("v1"), 2) / (F.col("v0") * F.col("v0") + F.col("v1") * F.col("v1"))
    return d.where((F.col("v0") + F.col("v1")) > 0).select(
        *by, day, "m0", "m1", ((F.col("m0") - F.col("m1")) / F.sqrt(se2)).alias("t"), dof.alias("df"),
        (F.abs(F.col("m1") - F.col("m0")) / pooled).alias("d"),
    )


def cusum_inflection(df: DataFrame, value: str, by: Sequence[str], threshold_sd: float = 0.5, day: str = "day") -> DataFrame:
    """Days where the second difference of the centred cumulative sum changes sign
    while the sum itself is at least ``threshold_sd`` of its sd."""
    w, whole = series(by, day), Window.partitionBy(*by)
    d = df.where(F.col(value).isNotNull()).withColumn("_c", F.col(value) - F.avg(value).over(whole))
    d = d.withColumn("cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # second difference at row i is c[i+2] - c[i+1]; a flip between rows i-1 and i reports row i
    flip = lambda k: F.signum(F.lead("_c", k + 2).over(w) - F.lead("_c", k + 1).over(w))
    here, prev = flip(0), F.signum(F.lead("_c", 1).over(w) - F.col("_c"))
    d = d.withColumn("_flip", F.coalesce(here != prev, F.lit(False)) & (F.row_number().over(w) > 1))
    sd = F.stddev_pop("cum").over(whole)
    d = d.withColumn("_sd", sd).withColumn("_n", F.count("*").over(whole))
    return d.where(F.col("_flip") & (F.col("_n") >= 10) & (F.col("_sd") > 0) & (F.abs("cum") >= threshold_sd * F.col("_sd"))).select(*by, day, "cum")


def alert_machine(df: DataFrame, by: Sequence[str], pre: str = "p_pre", active: str = "p_active", day: str = "day") -> DataFrame:
    """RED on high probabilities, YELLOW on the third day in a row of raised
    pre-flare probability; a RED day breaks the run."""
    red = (F.col(pre) > RED_PRE) | (F.col(active) > RED_ACTIVE)
    raised = ~red & (F.col(pre) > YELLOW_PRE)
    w = series(by, day)
    d = df.withColumn("_red", red).withColumn("_up", raised)
    d = d.withColumn("_run", F.sum(F.when(F.col("_up"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_k", F.sum(F.col("_up").cast("int")).over(Window.partitionBy(*by, "_run").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)))
    level = F.when(F.col("_red"), "RED").when(F.col("_up") & (F.col("_k") == YELLOW_RUN), "YELLOW")
    return d.withColumn("level", level).where("level IS NOT NULL").drop("_red", "_up", "_run", "_k")


def alert_validation(alerts: DataFrame, events: DataFrame, by: Sequence[str], day: str = "day", reach: int = 3) -> DataFrame:
    """First alert at or before the known event, lead time, and REDs inside and outside the event window."""
    a = alerts.join(events, list(by))
    early = F.col(day) <= F.col("event_date")
    near = F.abs(F.datediff(day, "event_date")) <= reach
    red, yellow = F.col("level") == "RED", F.col("level") == "YELLOW"
    g = a.groupBy(*by, "event_date").agg(
        F.min(F.when(early & red, F.col(day))).alias("first_red"), F.min(F.when(early & yellow, F.col(day))).alias("first_yellow"),
        F.count_if(red & near).alias("red_in_window"), F.count_if(red & ~near).alias("red_outside"),
    )
    return g.withColumn("red_lead_days", F.datediff("event_date", "first_red").cast("bigint")).withColumn(
        "yellow_lead_days", F.datediff("event_date", "first_yellow").cast("bigint")
    )
