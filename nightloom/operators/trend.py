"""Regressions in closed form from combining aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_number(by: Sequence[str], day: str = "day") -> Column:
    return F.datediff(day, F.min(day).over(Window.partitionBy(*by)))


def ols(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """slope, intercept, r2, n, standard error, t, residual sd and standardised beta."""
    a, b = F.col(y), F.col(x)
    g = df.groupBy(*by).agg(
        F.regr_count(a, b).alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"),
        F.regr_r2(a, b).alias("r2"), F.regr_sxx(a, b).alias("sxx"), F.regr_syy(a, b).alias("syy"), F.regr_sxy(a, b).alias("sxy"),
        F.regr_avgx(a, b).alias("xbar"),
    ).where((F.col("n") >= 3) & (F.col("sxx") > 0))
    sse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    g = g.withColumn("sse", sse).withColumn("resid_sd", F.sqrt(F.col("sse") / (F.col("n") - 2)))
    g = g.withColumn("se", F.col("resid_sd") / F.sqrt("sxx"))
    return g.withColumn("t", F.col("slope") / F.nullif(F.col("se"), F.lit(0.0))).withColumn(
        "beta", F.col("slope") * F.sqrt(F.col("sxx") / F.nullif(F.col("syy"), F.lit(0.0)))
    )


def prediction_band(fit: DataFrame, at: Column, crit: float = 1.959963984540054) -> DataFrame:
    """Value and band of the fitted line at one position."""
    mid = F.col("intercept") + F.col("slope") * at
    half = crit * F.col("resid_sd") * F.sqrt(1 + 1 / F.col("n") + F.pow(at - F.col("xbar"), 2) / F.col("sxx"))
    return fit.withColumn("pred", mid).withColumn("lo", mid - half).withColumn("hi", mid + half)


def cosinor(df: DataFrame, value: str, hour: Column, by: Sequence[str], period: float = 24.0) -> DataFrame:
    """MESOR, amplitude, hour of the peak, acrophase and R2 of one cosine, from its normal equations.

    ``acrophase_h`` is the negative phase angle as hours on the clock, ``peak_h``
    the hour at which the fitted curve is highest.
    """
    th = hour * F.lit(2 * math.pi / period)
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("y"), F.cos(th).alias("c"), F.sin(th).alias("s"))
    g = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("c").alias("mc"), F.avg("s").alias("ms"),
        F.var_pop("c").alias("cc"), F.var_pop("s").alias("ss"), F.covar_pop("c", "s").alias("cs"),
        F.covar_pop("c", "y").alias("cy"), F.covar_pop("s", "y").alias("sy"), F.var_pop("y").alias("yy"),
    )
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    g = g.where((det > 1e-12) & (F.col("n") >= 4))
    b = (F.col("cy") * F.col("ss") - F.col("sy") * F.col("cs")) / det
    a = (F.col("sy") * F.col("cc") - F.col("cy") * F.col("cs")) / det
    g = g.withColumn("beta", b).withColumn("gamma", a)
    phase = F.atan2("gamma", "beta") * period / (2 * math.pi)
    return g.select(
        *by, "n", (F.col("my") - F.col("beta") * F.col("mc") - F.col("gamma") * F.col("ms")).alias("mesor"),
        F.sqrt(F.col("beta") * F.col("beta") + F.col("gamma") * F.col("gamma")).alias("amplitude"),
        F.when(phase < 0, phase + period).otherwise(phase).alias("peak_h"),
        F.when(phase > 0, period - phase).otherwise(-phase).alias("acrophase_h"),
        ((F.col("beta") * F.col("cy") + F.col("gamma") * F.col("sy")) / F.nullif(F.col("yy"), F.lit(0.0))).alias("r2"),
    )


#: Time constants tried by the recovery fit, in days.
TAU_GRID = tuple(float(round(10 ** (k / 8), 4)) for k in range(0, 25))


def exp_recovery(df: DataFrame, y: str, t: str, by: Sequence[str], taus: Sequence[float] = TAU_GRID, max_gain: float = 500.0, max_base: float = 200.0) -> DataFrame:
    """y = gain (1 - exp(-t/tau)) + base: for each tau the rest is linear; the smallest SSE wins."""
    d = df.where(F.col(y).isNotNull()).select(*by, F.col(y).alias("_y"), F.col(t).alias("_t"), F.explode(F.array(*[F.lit(x) for x in taus])).alias("tau"))
    u = 1 - F.exp(-F.col("_t") / F.col("tau"))
    d = d.withColumn("_u", u)
    g = d.groupBy(*by, "tau").agg(
        F.count("*").alias("n"), F.regr_slope("_y", "_u").alias("gain"), F.regr_intercept("_y", "_u").alias("base"),
        F.regr_sxx("_y", "_u").alias("_sxx"), F.regr_sxy("_y", "_u").alias("_sxy"), F.regr_syy("_y", "_u").alias("syy"),
    ).where((F.col("n") >= 5) & (F.col("_sxx") > 1e-12))
    g = g.withColumn("sse", F.greatest(F.col("syy") - F.col("gain") * F.col("_sxy"), F.lit(0.0)))
    g = g.where(F.col("gain").between(0, max_gain) & F.col("base").between(-max_base, max_base))
    best = g.groupBy(*by).agg(F.min_by(F.struct("tau", "n", "gain", "base", "sse", "syy"), F.struct(F.round("sse", 9), "tau")).alias("m"))
    out = best.select(*by, "m.*")
    return out.withColumn("r2", 1 - F.col("sse") / F.nullif(F.col("syy"), F.lit(0.0)))


def information_criteria(sse: Column, n: Column, k: int) -> tuple[Column, Column]:
    """(AIC, BIC) of a least-squares fit with k parameters."""
    core = n * F.log(sse / n + 1e-15)
    return core + 2 * k, core + k * F.log(n)


def model_choice(linear: DataFrame, curve: DataFrame, by: Sequence[str]) -> DataFrame:
    la, lb = information_criteria(F.col("sse"), F.col("n"), 2)
    ca, cb = information_criteria(F.col("c_sse"), F.col("c_n"), 3)
    c = curve.select(*by, F.col("sse").alias("c_sse"), F.col("n").alias("c_n"), "tau", "gain", "base")
    j = linear.join(c, list(by), "left").withColumn("aic_linear", la).withColumn("bic_linear", lb).withColumn("aic_exp", ca).withColumn("bic_exp", cb)
    return j.withColumn("best", F.when(F.col("aic_exp") < F.col("aic_linear"), "exponential").otherwise("linear"))


def crossing(fit: DataFrame, target: Column | float, direction: str, ref: date, cap_days: int = 365) -> DataFrame:
    """Dates on which the line and the recovery curve reach a target.

    ``above`` needs a rising, ``below`` a falling trend; anything later than the
    cap or already behind is NULL.
    """
    goal = target if isinstance(target, Column) else F.lit(float(target))
    moving = F.col("slope") > 0 if direction == "above" else F.col("slope") < 0
    wait = F.when(moving, (goal - F.col("intercept")) / F.col("slope"))
    out = fit.withColumn("linear_days", F.when(wait.between(0, cap_days + 1 - 1e-9), F.floor(wait)))
    if "gain" in fit.columns:
        ratio = (goal - F.col("base")) / F.nullif(F.col("gain"), F.lit(0.0))
        bend = F.when((ratio > 0) & (ratio < 1) & F.lit(direction == "above"), -F.col("tau") * F.log(1 - ratio))
        out = out.withColumn("exp_days", F.when(bend.between(0, cap_days + 1 - 1e-9), F.floor(bend)))
    for c in [c for c in ("linear_days", "exp_days") if c in out.columns]:
        out = out.withColumn(c.replace("_days", "_date"), F.date_add(F.lit(ref), F.col(c).cast("int")))
    return out


def scenarios(fit: DataFrame, target: float, direction: str, ref: date, cap_days: int = 365) -> DataFrame:
    """Optimistic, expected and pessimistic crossing: slope plus or minus its standard error."""
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(k).alias("k")) for n, k in (("optimistic", 1.0), ("expected", 0.0), ("pessimistic", -1.0))])
    sign = 1.0 if direction == "above" else -1.0
    s = fit.select("*", F.inline(rows)).withColumn("slope", F.col("slope") + sign * F.col("k") * F.col("se"))
    out = crossing(s, target, direction, ref, cap_days)
    return out.withColumn("status", F.when(F.col("linear_days").isNotNull(), "reached").otherwise("not_reached"))


def residual_acf(df: DataFrame, value: str, by: Sequence[str], lags: int = 7, day: str = "day") -> DataFrame:
    """Autocorrelation at lags 1..k around the series mean, and the Ljung-Box sum, in one pass over one window."""
    w = Window.partitionBy(*by).orderBy(day)
    d = df.where(F.col(value).isNotNull()).withColumn("_e", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    d = d.select(*by, "_e", *[F.lag("_e", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    g = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("_v"), *[F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)]
    ).where(F.col("_v") > 0)
    r = [F.col(f"_c{k}") / F.col("_v") for k in range(1, lags + 1)]
    lb = sum((F.when(F.col("n") > k, r[k - 1] * r[k - 1] / (F.col("n") - k)).otherwise(0.0) for k in range(1, lags + 1)), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), r[k - 1].alias("r")) for k in range(1, lags + 1)])
    return g.withColumn("ljung_box", F.col("n") * (F.col("n") + 2) * lb).select(*by, "n", "ljung_box", F.inline(rows))
