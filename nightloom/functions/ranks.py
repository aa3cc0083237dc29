"""Ranks, quantiles and rank tests that survive a hot group.

A group may hold any share of the rows, so no step sorts a whole group in one
task.  Rows collapse to (group, value, count) first; the values then fall into
magnitude buckets - a monotone function of the value alone, hence the same on
every evaluation - whose running counts give each bucket its offset.  Only the
inside of one bucket is ever ordered by a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import norm_p2
from .tails import rank_sum_p

#: Buckets per doubling of the magnitude.
RESOLUTION = 4096


def magnitude_bucket(v: Column | str, resolution: int = RESOLUTION) -> Column:
    """Order-preserving bucket of a double: sign times scaled log2 of the magnitude."""
    v = F.col(v) if isinstance(v, str) else v
    level = F.floor((F.log2(F.greatest(F.abs(v), F.lit(1e-300))) + 1000) * resolution)
    return F.when(v == 0, F.lit(0)).when(v > 0, level).otherwise(-level).cast("bigint")


def tie_table(df: DataFrame, groups: Sequence[str], value: str, classes: dict[str, Column] | None = None) -> DataFrame:
    """One row per (group, value): ``ties`` rows hold it, ``below`` rows are smaller, ``total`` rows in all.

    ``classes`` adds one count per named condition.
    """
    groups = list(groups)
    counts = [F.count("*").alias("ties")]
    counts += [F.count(F.when(c, 1)).alias(n) for n, c in (classes or {}).items()]
    hist = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*groups, (F.col(value) + F.lit(0.0)).alias(value)).agg(*counts)
        .withColumn("_b", magnitude_bucket(value))
    )
    across = Window.partitionBy(*groups).orderBy("_b")
    offsets = hist.groupBy(*groups, "_b").agg(F.sum("ties").alias("_n")).select(
        *groups, "_b",
        (F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("total"),
    )
    inside = Window.partitionBy(*groups, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.join(offsets, [*groups, "_b"])
        .withColumn("below", F.col("_before") + F.sum("ties").over(inside) - F.col("ties"))
        .drop("_b", "_before")
    )


def mid_rank(below: Column | str = "below", ties: Column | str = "ties") -> Column:
    """Average rank of tied values, 1-based."""
    b = F.col(below) if isinstance(below, str) else below
    t = F.col(ties) if isinstance(ties, str) else ties
    return b + (t + 1) / 2


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of groups of any size, selected in two passes.

    The first pass counts rows per magnitude bucket, a few thousand numbers for each group and task; the second one reads
    only the buckets that hold a wanted rank, so of all values a handful of buckets is shuffled and ordered.
    """
    groups = list(groups)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = known.select(*groups, (F.col(value) + F.lit(0.0)).alias(value)).withColumn("_b", magnitude_bucket(value))
    across = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = rows.groupBy(*groups, "_b").agg(F.count("*").alias("_n")).select(
        *groups, "_b", "_n", (F.sum("_n").over(across) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*groups)).alias("total")
    )
    ranks = [rank((F.col("total") - 1) * F.lit(float(p))) for p in probs.values() for rank in (F.floor, F.ceil)]
    wanted = F.lit(False)
    for rank in ranks:
        wanted = wanted | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")))
    held = rows.join(buckets.where(wanted).drop("_n"), [*groups, "_b"]).groupBy(*groups, "_b", value, "_before", "total").agg(F.count("*").alias("ties"))
    inside = Window.partitionBy(*groups, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    t = held.withColumn("below", F.col("_before") + F.sum("ties").over(inside) - F.col("ties"))
    aggs = []
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("ties"))
        low = F.max(F.when(holds(lo), F.col(value)))
        high = F.max(F.when(holds(hi), F.col(value)))
        frac = F.max(pos - lo)
        aggs.append((low + (high - low) * frac).alias(name))
    return t.groupBy(*groups).agg(*aggs)


def histogram_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles through a value histogram, for readings of a sensor.

    The state per group is one entry per distinct reading, which the resolution
    of the sensor bounds.  For arbitrary doubles use :func:`exact_quantiles`.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    return hist.groupBy(*groups).agg(*[F.percentile(value, F.lit(float(p)), F.col("_n")).alias(n) for n, p in probs.items()])


def mann_whitney(df: DataFrame, groups: Sequence[str], value: str, first: Column) -> DataFrame:
    """U of the rows where ``first`` holds against the others, tie-corrected.

    Out: n1, n2, u1, u2, z (continuity-corrected), delta (Cliff) and rank_biserial.
    """
    t = tie_table(df, groups, value, {"_n1": first})
    s = t.groupBy(*groups).agg(
        F.sum("_n1").alias("n1"), (F.sum("ties") - F.sum("_n1")).alias("n2"),
        F.sum(F.col("_n1") * mid_rank()).alias("r1"),
        F.sum(F.pow(F.col("ties").cast("double"), 3) - F.col("ties")).alias("tie_term"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    top = F.greatest(u1, n1 * n2 - u1)
    return s.where((n1 > 0) & (n2 > 0)).select(
        *groups, "n1", "n2", u1.alias("u1"), (n1 * n2 - u1).alias("u2"),
        F.when(sd > 0, F.greatest((top - n1 * n2 / 2 - 0.5) / sd, F.lit(0.0))).alias("z"),
        (2 * u1 / (n1 * n2) - 1).alias("delta"),
    )


def mann_whitney_p(df: DataFrame, groups: Sequence[str], value: str, first: Column, exact_n: int = 20) -> DataFrame:
    """Rank-sum test with one p column: exact, ties included, up to ``exact_n`` rows in all, else normal; ``method`` says which.

    Only the tie groups of small tests, at most ``exact_n`` numbers each, are gathered for the exact count.
    """
    groups = list(groups)
    t = tie_table(df, groups, value, {"_n1": first})
    small = F.when(F.col("total") <= exact_n, F.struct("below", "ties", (2 * F.col("below") + F.col("ties") + 1).alias("rank2")))
    lists = t.groupBy(*groups).agg(
        F.sort_array(F.collect_list(small)).alias("_g"), F.sum(F.col("_n1") * (2 * F.col("below") + F.col("ties") + 1)).alias("_s"), F.max("total").alias("_total")
    )
    tested = mann_whitney(df, groups, value, first).join(lists, groups)
    exact = F.col("_total") <= exact_n
    part = lambda f: F.when(exact, F.transform("_g", lambda g: g[f].cast("long")))
    p = F.when(exact, rank_sum_p(part("ties"), part("rank2"), F.col("n1"), F.col("_s"))).otherwise(norm_p2("z"))
    return tested.select(*groups, "n1", "n2", "u1", "u2", "delta", p.alias("p"), F.when(exact, "exact").otherwise("normal").alias("method"))


def kruskal(df: DataFrame, groups: Sequence[str], value: str, klass: str) -> DataFrame:
    """H over the levels of ``klass`` with tie correction, and its degrees of freedom."""
    groups = list(groups)
    if not groups:
        return kruskal(df.withColumn("_all", F.lit(1)), ["_all"], value, klass).drop("_all")
    t = tie_table(df, groups, value)
    per = (
        df.where(F.col(value).isNotNull()).groupBy(*groups, klass, (F.col(value) + F.lit(0.0)).alias(value)).agg(F.count("*").alias("_c"))
        .join(t, [*groups, value])
    )
    by_class = per.groupBy(*groups, klass).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * mid_rank()).alias("r"))
    ties = t.groupBy(*groups).agg(F.sum(F.pow(F.col("ties").cast("double"), 3) - F.col("ties")).alias("tie_term"))
    h = by_class.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), (F.count("*") - 1).alias("df")
    )
    n = F.col("n").cast("double")
    out = h.join(ties, groups)
    fix = F.lit(1.0) - F.col("tie_term") / F.nullif(n * n * n - n, F.lit(0.0))
    return out.select(*groups, "n", "df", F.when(fix > 0, (F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / fix).alias("h"))


def percent_of_self(value: str, by: Sequence[str]) -> Column:
    """Mid-rank share of one's own (calendar-bounded) series, 0-100."""
    w = Window.partitionBy(*by)
    rank = F.rank().over(w.orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return (rank + (ties - 1) / 2) / F.count("*").over(w) * 100


def benjamini_hochberg(df: DataFrame, by: Sequence[str], p: str, out: str = "q") -> DataFrame:
    """q-values over the tests of one family (a metric registry, so a small group)."""
    usable = df.where(F.col(p) < 1)
    w = Window.partitionBy(*by)
    m = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(F.col(p), "metric"))
    step = usable.withColumn("_s", F.col(p) * m / rank)
    back = w.orderBy(F.col(p).desc(), F.col("metric").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn(out, F.least(F.min("_s").over(back), F.lit(1.0))).drop("_s")


def bonferroni(p: Column | str, by: Sequence[str]) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.least(p * F.count("*").over(Window.partitionBy(*by)), F.lit(1.0))
