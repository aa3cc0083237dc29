"""Correlation between metrics, with lags, intervals and labels.

Pairs are pairs of registry columns (a fixed few), never pairs of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.ranks import kruskal
from .windows import pearson

Z975 = 1.959963984540054


def lagged_long(daily: DataFrame, xs: Sequence[str], ys: Sequence[str], lags: Sequence[int], by: Sequence[str], day: str = "day") -> DataFrame:
    """(x_name, y_name, lag, x, y) rows of complete pairs; all shifts share one window."""
    w = Window.partitionBy(*by).orderBy(day)
    cells = []
    for lag in lags:
        for y in ys:
            moved = F.lead(y, lag).over(w) if lag > 0 else F.lag(y, -lag).over(w) if lag < 0 else F.col(y)
            cells.append((y, lag, moved))
    d = daily.select("*", *[c.alias(f"_y{i}") for i, (_, _, c) in enumerate(cells)])
    rows = [
        F.struct(F.lit(x).alias("x_name"), F.lit(y).alias("y_name"), F.lit(lag).alias("lag"), F.col(x).cast("double").alias("x"), F.col(f"_y{i}").cast("double").alias("y"))
        for x in xs for i, (y, lag, _) in enumerate(cells) if not (x == y and lag == 0)
    ]
    return d.select(*by, F.inline(F.array(*rows))).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def mid_ranks(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank inside one calendar-bounded series."""
    w = Window.partitionBy(*by)
    tie = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (tie - 1) / 2)


def pair_corr(pairs: DataFrame, by: Sequence[str], method: str = "spearman", min_n: int = 5) -> DataFrame:
    """r and n per key; NULL below ``min_n`` pairs or without variation."""
    x, y = "x", "y"
    if method == "spearman":
        pairs = mid_ranks(mid_ranks(pairs, by, "x", "_rx"), by, "y", "_ry")
        x, y = "_rx", "_ry"
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), pearson(x, y).alias("_r"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"))
    ok = (F.col("n") >= min_n) & (F.col("_sx") > 0) & (F.col("_sy") > 0)
    return g.select(*by, "n", F.when(ok, F.col("_r")).alias("r"))


def atanh(r: Column) -> Column:
    c = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), r))
    return F.when(r.isNotNull(), F.log((1 + c) / (1 - c)) / 2)


def fisher_ci(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    z, se = atanh(F.col(r)), F.lit(1.0) / F.sqrt(F.col(n) - 3)
    ok = (F.col(n) >= 4) & F.col(r).isNotNull()
    return df.withColumn("ci_lo", F.when(ok, F.tanh(z - Z975 * se))).withColumn("ci_hi", F.when(ok, F.tanh(z + Z975 * se)))


def corr_t(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """t of a correlation; its p follows with ``with_t_p`` on n - 2 degrees of freedom."""
    rr = F.col(r)
    return df.withColumn("t", F.when(F.abs(rr) < 1, rr * F.sqrt((F.col(n) - 2) / (1 - rr * rr)))).withColumn("df", F.col(n) - 2)


def lag_table(daily: DataFrame, xs: Sequence[str], ys: Sequence[str], lags: Sequence[int], by: Sequence[str] = ("entity_id",)) -> DataFrame:
    keys = [*by, "x_name", "y_name", "lag"]
    return corr_t(fisher_ci(pair_corr(lagged_long(daily, xs, ys, lags, by), keys)))


def significant(df: DataFrame, alpha: float = 0.10) -> DataFrame:
    return df.withColumn("p", tails.t_p2(F.col("t"), F.col("df").cast("double"))).withColumn("sig", F.col("p") < alpha)


def corr_matrix(daily: DataFrame, metrics: Sequence[str], by: Sequence[str], lag: int = 0, method: str = "pearson") -> DataFrame:
    """Long matrix of r over ordered metric pairs at one lag."""
    keys = [*by, "x_name", "y_name"]
    return pair_corr(lagged_long(daily, metrics, metrics, [lag], by), keys, method)


def compare_correlations(df: DataFrame, key: Sequence[str], pairs: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Fisher r-to-z between the correlations of the entities of each pair (left_id, right_id), for every key."""
    side = lambda name: df.select(F.col(entity).alias(f"{name}_id"), *key, F.col("r").alias(f"{name}_r"), F.col("n").alias(f"{name}_n"))
    g = pairs.join(side("left"), "left_id").join(side("right"), ["right_id", *key])
    se = F.sqrt(1 / (F.col("left_n") - 3) + 1 / (F.col("right_n") - 3))
    return g.withColumn("z", F.when((F.col("left_n") >= 4) & (F.col("right_n") >= 4), (atanh(F.col("left_r")) - atanh(F.col("right_r"))) / se))


# Limits of direction (0.15, p 0.10), strength (0.25, 0.4) and of a small sample (30).
def coupling_label(df: DataFrame, r: str = "r", p: str = "p", n: str = "n") -> DataFrame:
    rr, size = F.col(r), F.abs(F.col(r))
    real = F.col(p) < 0.10
    direction = (
        F.when(rr.isNull() | F.col(p).isNull(), "insufficient_data")
        .when((rr > 0.15) & real, "positive").when((rr < -0.15) & real, "negative").otherwise("absent")
    )
    d = df.withColumn("direction", direction)
    coupled = F.col("direction").isin("positive", "negative")
    strength = (
        F.when(F.col("direction") == "insufficient_data", "unknown").when(~coupled, "negligible")
        .when(size > 0.4, "strong").when(size > 0.25, "moderate").otherwise("weak")
    )
    rating = (
        F.when(F.col("direction") == "positive", "adaptive").when(F.col("direction") == "negative", "maladaptive")
        .when((F.col("direction") == "absent") & (F.col(n) < 30), "underpowered").otherwise("decoupled")
    )
    return d.withColumn("strength", strength).withColumn("rating", rating)


def dose_response(daily: DataFrame, dose: str, response: str, by: Sequence[str], day: str = "day") -> tuple[DataFrame, DataFrame]:
    """Next-row response by adaptive quantile bin of the dose: (bins, Kruskal H per key).

    Bins follow value edges (ties stay together, empty bins drop), 4 from 40
    pairs on, 3 from 20, else 2.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(day)
    d = daily.select(*by, F.col(dose).alias("x"), F.lead(response, 1).over(w).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    whole = Window.partitionBy(*by)
    n = F.count("*").over(whole)
    cuts = {2: (0.5,), 3: (1 / 3, 2 / 3), 4: (0.25, 0.5, 0.75)}
    above = lambda k: sum((F.col("x") > F.percentile("x", F.lit(p)).over(whole)).cast("int") for p in cuts[k])
    d = d.withColumn("n_pairs", n).withColumn("bin", F.when(n >= 40, above(4)).when(n >= 20, above(3)).otherwise(above(2))).where("n_pairs >= 6")
    bins = d.groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), F.min("x").alias("dose_lo"), F.max("x").alias("dose_hi"), F.stddev_samp("y").alias("sd")
    ).where("n >= 2")
    return bins, kruskal(d, by, "y", "bin")


def convergence_gap(signals: DataFrame, pairs: DataFrame, k: int = 14, entity: str = "entity_id", value: str = "value") -> DataFrame:
    """Do the series of the entities of a pair (left_id, right_id) approach each other from their first to their last k rows?"""
    from .windows import first_rows, last_rows

    by = [entity, "metric"]
    d = signals.withColumn("_a", first_rows(by, k)).withColumn("_b", last_rows(by, k))
    ends = d.groupBy(*by).agg(F.avg(F.when(F.col("_a"), F.col(value))).alias("early"), F.avg(F.when(F.col("_b"), F.col(value))).alias("late"))
    side = lambda name: ends.select(F.col(entity).alias(f"{name}_id"), "metric", F.col("early").alias(f"{name}_early"), F.col("late").alias(f"{name}_late"))
    j = pairs.join(side("left"), "left_id").join(side("right"), ["right_id", "metric"])
    gap = lambda at: F.abs(F.col(f"left_{at}") - F.col(f"right_{at}")).alias(f"gap_{at}")
    g = j.select("left_id", "right_id", "metric", gap("early"), gap("late"))
    return g.withColumn("converging", F.col("gap_late") < F.col("gap_early"))


def mediation(daily: DataFrame, x: str, m: str, y: str, by: Sequence[str]) -> DataFrame:
    """Paths of x -> m -> y from covariances of one combining aggregate.

    a: m on x, c: y on x, b and c_prime: y on m and x together.
    """
    ok = F.col(x).isNotNull() & F.col(m).isNotNull() & F.col(y).isNotNull()
    g = daily.where(ok).groupBy(*by).agg(
        F.count("*").alias("n"), F.var_samp(x).alias("vx"), F.var_samp(m).alias("vm"),
        F.covar_samp(x, m).alias("xm"), F.covar_samp(x, y).alias("xy"), F.covar_samp(m, y).alias("my"),
    )
    det = F.col("vx") * F.col("vm") - F.col("xm") * F.col("xm")
    g = g.where((F.col("vx") > 0) & (det > 0))
    out = g.select(
        *by, "n", (F.col("xm") / F.col("vx")).alias("a"), (F.col("xy") / F.col("vx")).alias("c"),
        ((F.col("my") * F.col("vx") - F.col("xy") * F.col("xm")) / det).alias("b"),
        ((F.col("xy") * F.col("vm") - F.col("my") * F.col("xm")) / det).alias("c_prime"),
    )
    return out.withColumn("indirect", F.col("a") * F.col("b")).withColumn(
        "proportion", F.when(F.abs("c") > 1e-10, F.col("a") * F.col("b") / F.col("c"))
    )
