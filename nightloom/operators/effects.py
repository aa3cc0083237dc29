"""Effect sizes, two-sample tests and phase summaries from grouped moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.ranks import bonferroni, mann_whitney
from ..functions.scalar import named_band, norm_p2


def phase_summary(signals: DataFrame, by: Sequence[str], phase: str = "phase", value: str = "value") -> DataFrame:
    return signals.groupBy(*by, phase).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("sd")
    )


def two_sample(signals: DataFrame, by: Sequence[str], first: Column, value: str = "value") -> DataFrame:
    """Moments of the rows where ``first`` holds (1) and of the others (2); one combining aggregate."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    return signals.groupBy(*by).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"),
        F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"), F.stddev_pop(a).alias("sp1"),
    )


def effect_sizes(m: DataFrame) -> DataFrame:
    """Second sample against the first: pooled d, average-variance d, shift in SDs, percent change."""
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    diff = F.col("m2") - F.col("m1")
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif(n1 + n2 - 2, F.lit(0)))
    nz = lambda c: F.nullif(c, F.lit(0.0))
    return (
        m.withColumn("d", diff / nz(pooled)).withColumn("d_avg", diff / nz(F.sqrt((v1 + v2) / 2)))
        .withColumn("shift_sd", diff / nz(F.col("sp1"))).withColumn("pct_change", diff / nz(F.abs("m1")) * 100)
        .withColumn("d_label", named_band(F.abs("d"), "cohens_d"))
    )


def welch(m: DataFrame) -> DataFrame:
    q1, q2 = F.col("v1") / F.nullif(F.col("n1"), F.lit(0)), F.col("v2") / F.nullif(F.col("n2"), F.lit(0))
    t = (F.col("m1") - F.col("m2")) / F.nullif(F.sqrt(q1 + q2), F.lit(0.0))
    df = (q1 + q2) * (q1 + q2) / F.nullif(q1 * q1 / F.nullif(F.col("n1") - 1, F.lit(0)) + q2 * q2 / F.nullif(F.col("n2") - 1, F.lit(0)), F.lit(0.0))
    return m.withColumn("t", t).withColumn("df", df)


def with_t_p(df: DataFrame, t: str = "t", dof: str = "df", out: str = "p") -> DataFrame:
    return df.withColumn(out, tails.t_p2(F.col(t), F.col(dof).cast("double")))


def levene(signals: DataFrame, by: Sequence[str], klass: str, value: str = "value") -> DataFrame:
    """Median-centred Levene F with its degrees of freedom, and the variance ratio of two classes.

    The class medians come from one daily series each, so their state is
    calendar-bounded; the rest are combining moments.
    """
    w = Window.partitionBy(*by, klass)
    d = signals.where(F.col(value).isNotNull()).withColumn("_z", F.abs(F.col(value) - F.median(value).over(w)))
    g = d.groupBy(*by, klass).agg(
        F.count("*").alias("n"), F.avg("_z").alias("m"), F.var_pop("_z").alias("v"), F.var_samp(value).alias("raw")
    )
    t = g.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"),
        F.sum(F.col("n") * F.col("v")).alias("inside"), F.max("raw").alias("_hi"), F.min("raw").alias("_lo"),
    )
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    return t.select(*by, df1.alias("df1"), df2.alias("df2"), ((between / F.nullif(df1, F.lit(0))) / F.nullif(F.col("inside") / F.nullif(df2, F.lit(0)), F.lit(0.0))).alias("f"), (F.col("_hi") / F.nullif(F.col("_lo"), F.lit(0.0))).alias("variance_ratio"))


def rank_battery(signals: DataFrame, by: Sequence[str], first: Column, family: Sequence[str], value: str = "value") -> DataFrame:
    """Per metric: U, Cliff's delta, normal p (tie and continuity corrected), Bonferroni p,
    pooled d, percent change and direction."""
    u = mann_whitney(signals, by, value, first)
    m = effect_sizes(two_sample(signals, by, first, value)).select(*by, "m1", "m2", "d", "pct_change")
    out = u.join(m, list(by)).withColumn("p", norm_p2("z"))
    return out.withColumn("p_bonferroni", bonferroni("p", family)).withColumn(
        "direction", F.when(F.col("m2") > F.col("m1"), "up").when(F.col("m2") < F.col("m1"), "down").otherwise("flat")
    )


def forest_table(effects: DataFrame, cap: float = 80.0) -> DataFrame:
    """Effects by p with significance tier and capped relative effect."""
    tier = F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("ns")
    rel = F.coalesce(F.col("pct_change"), (F.col("m2") - F.col("m1")) / F.nullif(F.abs("m1"), F.lit(0.0)) * 100)
    return effects.withColumn("tier", tier).withColumn("effect", F.greatest(F.lit(-cap), F.least(F.lit(cap), rel)))
