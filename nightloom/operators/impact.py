"""Intervention impact, placebo checks, lagged links and forecast evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import t975, t_p2
from .windows import pearson, series


def _pre_fit(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trend and weekday levels of the pre-period from sums per weekday.

    Within-weekday deviations give the slope; each weekday keeps its own mean
    position and level.  All of it is combining aggregates.
    """
    pre = d.where(F.col("day") < F.col("event_date"))
    per = pre.groupBy(*keys, "wd").agg(
        F.count("*").alias("n_w"), F.avg("t").alias("t_w"), F.avg("value").alias("y_w"),
        F.regr_sxx("value", "t").alias("sxx"), F.regr_sxy("value", "t").alias("sxy"), F.regr_syy("value", "t").alias("syy"),
    )
    tot = per.groupBy(*keys).agg(
        F.sum("n_w").alias("n_pre"), F.count("*").alias("k"), F.sum("sxx").alias("sxx"), F.sum("sxy").alias("sxy"), F.sum("syy").alias("syy"),
        F.collect_list(F.struct("wd", "n_w", "t_w", "y_w")).alias("levels"),
    )
    slope = F.col("sxy") / F.col("sxx")
    sse = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    dof = F.col("n_pre") - F.col("k") - 1
    return tot.where((F.col("sxx") > 0) & (dof > 0)).select(
        *keys, "n_pre", "sxx", dof.alias("dof"), slope.alias("slope"), (sse / dof).alias("s2"), "levels"
    )


def _prepare(signals: DataFrame, by: Sequence[str], extra: Sequence[str]) -> DataFrame:
    origin = F.lit("1970-01-01").cast("date")
    return signals.where(F.col("value").isNotNull()).select(
        *by, *extra, "day", "value", F.datediff("day", origin).cast("double").alias("t"), F.weekday("day").alias("wd")
    )


def impact(signals: DataFrame, by: Sequence[str], event: Column, min_pre: int = 14, min_post: int = 3, wide_ratio: float = 5.0, extra: Sequence[str] = ()) -> DataFrame:
    """Average effect after ``event`` against the projected pre-period: effect, relative effect, p, interval.

    p and interval are Student's on the degrees of freedom of the pre-period's fit.  The relative effect is NULL where it means nothing (prediction near 0, sign
    flip, effect as large as the prediction); ``low_confidence`` marks an interval
    much wider than the effect.
    """
    keys = [*by, *extra]
    d = _prepare(signals, by, extra).withColumn("event_date", event)
    fit = _pre_fit(d, keys)
    post = d.where(F.col("day") >= F.col("event_date")).groupBy(*keys, "wd").agg(
        F.count("*").alias("m_w"), F.avg("t").alias("t_post"), F.sum("value").alias("y_sum")
    )
    levels = fit.select(*keys, F.inline("levels"))
    j = post.join(levels, [*keys, "wd"]).join(fit.drop("levels"), keys)
    pred = F.col("y_w") + F.col("slope") * (F.col("t_post") - F.col("t_w"))
    g = j.groupBy(*keys).agg(
        F.max("n_pre").alias("n_pre"), F.sum("m_w").alias("n_post"), (F.sum("y_sum") / F.sum("m_w")).alias("actual"),
        (F.sum(F.col("m_w") * pred) / F.sum("m_w")).alias("predicted"), F.max("s2").alias("s2"), F.max("sxx").alias("sxx"), F.max("dof").alias("dof"),
        F.sum(F.col("m_w") * F.col("m_w") / F.col("n_w")).alias("_lv"), F.sum(F.col("m_w") * (F.col("t_post") - F.col("t_w"))).alias("_far"),
    )
    m = F.col("n_post")
    var = F.col("s2") * (1 / m + F.col("_lv") / (m * m) + F.pow(F.col("_far") / m, 2) / F.col("sxx"))
    g = g.where((F.col("n_pre") >= min_pre) & (m >= min_post)).withColumn("effect", F.col("actual") - F.col("predicted")).withColumn("se", F.sqrt(var))
    ok = (F.abs("predicted") > 1e-10) & (F.col("actual") * F.col("predicted") > 0) & (F.abs("effect") < F.abs("predicted"))
    half = t975(F.col("dof")) * F.col("se")
    return g.select(
        *keys, "n_pre", "n_post", "actual", "predicted", "effect", F.when(ok, F.col("effect") / F.col("predicted") * 100).alias("relative_pct"),
        "se", "dof", t_p2(F.col("effect") / F.nullif(F.col("se"), F.lit(0.0)), F.col("dof")).alias("p"), (F.col("effect") - half).alias("ci_lo"), (F.col("effect") + half).alias("ci_hi"),
        ((F.abs("effect") >= 1e-10) & (2 * half > wide_ratio * F.abs("effect"))).alias("low_confidence"),
    )


def impact_series(signals: DataFrame, by: Sequence[str], event: Column) -> DataFrame:
    """Actual, predicted and band per day, for the side export."""
    keys = list(by)
    d = _prepare(signals, by, ()).withColumn("event_date", event)
    fit = _pre_fit(d, keys)
    j = d.join(fit.select(*keys, F.inline("levels")), [*keys, "wd"]).join(fit.drop("levels"), keys)
    pred = F.col("y_w") + F.col("slope") * (F.col("t") - F.col("t_w"))
    half = t975(F.col("dof")) * F.sqrt(F.col("s2") * (1 + 1 / F.col("n_w") + F.pow(F.col("t") - F.col("t_w"), 2) / F.col("sxx")))
    return j.select(*keys, "day", F.col("value").alias("actual"), pred.alias("pred"), (pred - half).alias("lo"), (pred + half).alias("hi"))


def placebo(signals: DataFrame, by: Sequence[str], event: Column, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The same estimate at dates inside the pre-period: one grouped job, a row per placebo date."""
    w = Window.partitionBy(*by)
    pre = signals.withColumn("_ev", event).where(F.col("day") < F.col("_ev"))
    first, last = F.min("day").over(w), F.max("day").over(w)
    dates = F.array(*[F.date_add(first, F.floor(F.datediff(last, first) * s).cast("int")) for s in shares])
    fan = pre.withColumn("_dates", dates).withColumn("placebo_date", F.explode("_dates")).drop("_ev", "_dates")
    return impact(fan, by, F.col("placebo_date"), extra=["placebo_date"]).withColumn("significant", F.col("p") < 0.05)


def placebo_verdict(tests: DataFrame, by: Sequence[str]) -> DataFrame:
    g = tests.groupBy(*by).agg(F.count("*").alias("n_tests"), F.count_if("significant").alias("n_significant"))
    return g.withColumn("verdict", F.when(F.col("n_significant") == 0, "PASS").when(F.col("n_significant") == 1, "PARTIAL").otherwise("FAIL"))


def lagged_links(daily: DataFrame, metrics: Sequence[str], by: Sequence[str], max_lag: int = 7, day: str = "day") -> DataFrame:
    """Partial correlation of y(t) and x(t - lag) given y(t - 1) and x(t - lag - 1), for every ordered pair and lag.

    Six correlations per (pair, lag) come from one aggregate; the partial
    correlation follows in closed form, and t on n - 4 degrees of freedom.
    """
    w = Window.partitionBy(*by).orderBy(day)
    frame = w.rowsBetween(-(max_lag + 1), -1)
    d = daily.select(*by, *metrics, *[F.reverse(F.collect_list(F.struct(F.col(m).alias("v"))).over(frame)).alias(f"_{m}") for m in metrics])

    def sources(m: str) -> Column:
        past = lambda k: F.get(F.col(f"_{m}"), k)["v"]
        return F.transform(F.sequence(F.lit(1), F.lit(max_lag)), lambda k: F.struct(F.lit(m).alias("source"), k.alias("lag"), past(k - 1).alias("x"), past(k).alias("b")))

    targets = F.array(*[F.struct(F.lit(m).alias("target"), F.col(m).alias("y"), F.get(F.col(f"_{m}"), F.lit(0))["v"].alias("a")) for m in metrics])
    lagged = d.select(*by, targets.alias("_t"), F.inline(F.flatten(F.array(*[sources(m) for m in metrics]))))
    long = lagged.select(*by, "source", "lag", "x", "b", F.inline("_t")).where(F.col("source") != F.col("target"))
    long = long.na.drop(subset=["x", "y", "a", "b"])
    pairs = ("xy", "xa", "xb", "ya", "yb", "ab")
    g = long.groupBy(*by, "source", "target", "lag").agg(F.count("*").alias("n"), *[pearson(p[0], p[1]).alias(p) for p in pairs])

    def part(r: Column, p: Column, q: Column) -> Column:
        free = (1 - p * p) * (1 - q * q)
        return (r - p * q) / F.sqrt(F.when(free > 1e-15, free))

    g = g.withColumn("_xy", part(F.col("xy"), F.col("xa"), F.col("ya"))).withColumn("_xb", part(F.col("xb"), F.col("xa"), F.col("ab"))).withColumn("_yb", part(F.col("yb"), F.col("ya"), F.col("ab")))
    g = g.withColumn("r", part(F.col("_xy"), F.col("_xb"), F.col("_yb"))).withColumn("t", F.col("r") * F.sqrt((F.col("n") - 4) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0))))
    return g.select(*by, "source", "target", "lag", "n", "r", "t", t_p2("t", F.col("n") - 4).alias("p"))


def link_changes(full: DataFrame, pre: DataFrame, by: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Links significant in the full data only (new) and before the event only (lost)."""
    keys = [*by, "source", "target", "lag"]
    side = lambda df, name: df.where(F.col("p") < alpha).select(*keys, F.lit(name).alias("_side"))
    both = side(full, "full").unionAll(side(pre, "pre")).groupBy(*keys)
    g = both.agg(F.max(F.col("_side") == "full").alias("_f"), F.max(F.col("_side") == "pre").alias("_p")).where(F.col("_f") != F.col("_p"))
    return g.select(*keys, F.when(F.col("_f"), "new").otherwise("lost").alias("change"))


# --- forecasts ---------------------------------------------------------------

def one_step_forecasts(signals: DataFrame, by: Sequence[str], day: str = "day", value: str = "value", context: int = 55, season: int = 7, damping: float = 0.9) -> DataFrame:
    """Last value, seasonal last value, and damped trend, each with bands from its own past errors.

    Everything a row needs lies in trailing frames of ``context`` rows.
    """
    w = series(by, day)
    frame = w.rowsBetween(-context, -1)
    d = signals.where(F.col(value).isNotNull()).select(*by, day, F.col(value).alias("actual"))
    d = d.withColumn("_l", F.lag("actual").over(w))
    drift = (F.col("_l") - F.first("actual").over(frame)) / F.nullif(F.count("actual").over(frame) - 1, F.lit(0))
    d = d.withColumn("_naive", F.col("_l")).withColumn("_seasonal", F.lag("actual", season).over(w)).withColumn("_trend", F.col("_l") + damping * F.coalesce(drift, F.lit(0.0)))
    names = ("naive", "seasonal", "trend")
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_{n}").alias("pred")) for n in names])
    long = d.select(*by, day, "actual", F.inline(rows)).where(F.col("pred").isNotNull()).withColumn("err", F.col("actual") - F.col("pred"))
    back = series([*by, "model"], day).rowsBetween(-context, -1)
    qs = F.percentile("err", F.array(*[F.lit(q) for q in (0.05, 0.25, 0.75, 0.95)])).over(back)
    long = long.withColumn("_q", F.when(F.count("err").over(back) >= 10, qs)).where(F.col("_q").isNotNull())
    cols = [(F.col("pred") + F.col("_q")[i]).alias(n) for i, n in enumerate(("lo90", "lo50", "hi50", "hi90"))]
    return long.select(*by, day, "model", "actual", "pred", *cols).withColumn("outside", (F.col("actual") < F.col("lo90")) | (F.col("actual") > F.col("hi90")))


def horizon_forecast(signals: DataFrame, by: Sequence[str], as_of: Column, horizon: int = 14, context: int = 55, day: str = "day", value: str = "value") -> DataFrame:
    """Last value with damped drift for the next days after ``as_of``, band widening with the root of the step."""
    past = signals.where((F.col(day) <= as_of) & F.col(value).isNotNull())
    w = Window.partitionBy(*by).orderBy(F.col(day).desc())
    d = past.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= context)
    d = d.withColumn("_step", F.col(value) - F.lag(value).over(series(by, day)))
    g = d.groupBy(*by).agg(F.max_by(value, day).alias("_last"), F.max(day).alias("_day"), F.avg("_step").alias("_drift"), F.stddev_samp("_step").alias("_sd"), F.count("*").alias("n"))
    g = g.where("n >= 3").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    damp = F.col("_drift") * (1 - F.pow(F.lit(0.9), F.col("step"))) / 0.1 * 0.9
    mid, half = F.col("_last") + damp, 1.6448536269514722 * F.col("_sd") * F.sqrt("step")
    return g.select(*by, "step", F.date_add("_day", F.col("step")).alias(day), mid.alias("pred"), (mid - half).alias("lo90"), (mid + half).alias("hi90"))


def forecast_scores(f: DataFrame, by: Sequence[str]) -> DataFrame:
    e = F.col("actual") - F.col("pred")
    sse, sst = F.sum(e * e), F.var_pop("actual") * F.count("*")
    return f.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / F.nullif(F.abs("actual"), F.lit(0.0))) * 100).alias("mape"), (1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"),
        F.avg(F.col("actual").between(F.col("lo50"), F.col("hi50")).cast("double")).alias("cover50"), F.avg(F.col("actual").between(F.col("lo90"), F.col("hi90")).cast("double")).alias("cover90"),
        F.avg(F.col("hi90") - F.col("lo90")).alias("width90"), F.count_if("outside").alias("n_outside"),
    )


def consensus_flag(a: DataFrame, b: DataFrame, by: Sequence[str], day: str = "day") -> DataFrame:
    """Both models outside: HIGH, one: MEDIUM, none: NORMAL."""
    x = a.select(*by, day, F.col("outside").cast("int").alias("_a"))
    y = b.select(*by, day, F.col("outside").cast("int").alias("_b"))
    votes = F.col("_a") + F.col("_b")
    return x.join(y, [*by, day]).select(*by, day, F.when(votes == 2, "HIGH").when(votes == 1, "MEDIUM").otherwise("NORMAL").alias("consensus"))


def width_change(f: DataFrame, by: Sequence[str], event: Column, day: str = "day") -> DataFrame:
    """Band width and hit rate before and from an event on."""
    pre = F.col(day) < event
    width = F.col("hi90") - F.col("lo90")
    g = f.groupBy(*by).agg(
        F.avg(F.when(pre, width)).alias("width_pre"), F.avg(F.when(~pre, width)).alias("width_post"), F.avg(F.when(pre, F.col("outside").cast("double"))).alias("outside_pre"), F.avg(F.when(~pre, F.col("outside").cast("double"))).alias("outside_post")
    )
    return g.withColumn("width_pct", (F.col("width_post") - F.col("width_pre")) / F.nullif(F.col("width_pre"), F.lit(0.0)) * 100)


def hourly_backtest(hourly: DataFrame, by: Sequence[str], hour: str = "hour_no", value: str = "value", context_days: int = 7, sigmas: float = 1.2815515655446004) -> DataFrame:
    """Each day is forecast at its first hour from the 168 hours before: mean of the same
    clock hour, band from the spread of those hours; flags hours outside.

    The sliding origins need no copies of their contexts: per clock hour and per
    day sums over a trailing range of days are the whole context.
    """
    d = hourly.select(*by, F.col(hour).alias("hour_no"), F.col(value).alias("actual")).withColumn("d", F.floor(F.col("hour_no") / 24)).withColumn("h", F.pmod("hour_no", F.lit(24)))
    same = Window.partitionBy(*by, "h").orderBy("d").rangeBetween(-context_days, -1)
    d = d.withColumn("pred", F.avg("actual").over(same))
    per = d.groupBy(*by, "d").agg(F.count("*").alias("_n"), F.sum("actual").alias("_s"), F.sum(F.col("actual") * F.col("actual")).alias("_q"))
    days = Window.partitionBy(*by).orderBy("d").rangeBetween(-context_days, -1)
    ctx = per.select(*by, "d", F.sum("_n").over(days).alias("n_context"), F.sum("_s").over(days).alias("_s"), F.sum("_q").over(days).alias("_q"))
    j = d.join(ctx, [*by, "d"])
    n = F.col("n_context")
    sd = F.sqrt(F.greatest((F.col("_q") - F.col("_s") * F.col("_s") / n) / (n - 1), F.lit(0.0)))
    j = j.where(n >= 24).withColumn("pred", F.coalesce("pred", F.col("_s") / n)).withColumn("sd", sd)
    out = F.abs(F.col("actual") - F.col("pred")) > sigmas * F.col("sd")
    return j.select(*by, "hour_no", "actual", "pred", "sd", "n_context", out.alias("outside"))
