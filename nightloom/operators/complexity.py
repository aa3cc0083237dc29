"""Complexity of bounded series: variability, histograms, information, fractality, recurrence.

A series is one value per day or per fixed slot.  What combines is expressed as
aggregates; where every point of a series meets every other (entropies,
recurrence) the bounded series travels as one array, its rows are cut into
blocks, and each block is counted with NumPy in its own task - pairs are counted,
never emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import named_band


def poincare(df: DataFrame, value: str, by: Sequence[str], order: str = "day", min_n: int = 10) -> DataFrame:
    """SD1, SD2 (from sums), SD2 (from the total variance), CVI and CSI of successive values."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.where(F.col(value).isNotNull()).withColumn("_n", F.lead(value).over(w))
    root2 = F.lit(math.sqrt(2))
    g = d.groupBy(*by).agg(
        F.count("*").alias("n"), (F.stddev_samp(F.col("_n") - F.col(value)) / root2).alias("sd1"),
        (F.stddev_samp(F.col("_n") + F.col(value)) / root2).alias("sd2"), F.var_samp(value).alias("_v"),
    ).where(F.col("n") >= min_n)
    ok = (F.col("sd1") > 0) & (F.col("sd2") > 0)
    alt = F.greatest(2 * F.col("_v") - F.col("sd1") * F.col("sd1"), F.lit(0.0))
    return g.select(
        *by, "n", "sd1", "sd2", F.sqrt(alt).alias("sd2_total"),
        F.when(ok, F.log10(F.col("sd1") * F.col("sd2"))).otherwise(0.0).alias("cvi"),
        F.when(ok, F.col("sd2") / F.col("sd1")).otherwise(0.0).alias("csi"),
    )


def stress_index(df: DataFrame, value: str, by: Sequence[str], width: float = 0.5, min_n: int = 10) -> DataFrame:
    """Mode amplitude over twice mode times range, from half-unit bins that start one bin below the minimum."""
    w = Window.partitionBy(*by)
    d = df.where(F.col(value).isNotNull()).withColumn("_lo", F.min(value).over(w))
    b = F.floor((F.col(value) - F.col("_lo") + width) / width)
    bins = d.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("c"), F.first("_lo").alias("_lo"), F.max(value).alias("_hi"))
    g = bins.groupBy(*by).agg(
        F.sum("c").alias("n"), F.max("c").alias("top"), F.max_by("bin", F.struct(F.col("c"), -F.col("bin"))).alias("mode_bin"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
    ).where(F.col("n") >= min_n)
    mode = F.col("_lo") - width + (F.col("mode_bin") + 0.5) * width
    g = g.withColumn("mode", mode).withColumn("amo_pct", F.col("top") / F.col("n") * 100).withColumn("range", F.col("_hi") - F.col("_lo"))
    si = F.when((F.col("mode") > 0) & (F.col("range") > 0), F.col("amo_pct") / (2 * F.col("mode") * F.col("range")) * 1000).otherwise(0.0)
    return g.withColumn("si", si).withColumn("level", named_band("si", "stress_index")).select(*by, "n", "mode", "amo_pct", "range", "si", "level")


def hjorth(df: DataFrame, value: str, by: Sequence[str], order: str = "day") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    d = df.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.lag(value).over(w))
    d = d.withColumn("_dd", F.col("_d") - F.lag("_d").over(w))
    g = d.groupBy(*by).agg(F.var_pop(value).alias("activity"), F.var_pop("_d").alias("_v1"), F.var_pop("_dd").alias("_v2"))
    g = g.where((F.col("activity") > 0) & (F.col("_v1") > 0)).withColumn("mobility", F.sqrt(F.col("_v1") / F.col("activity")))
    return g.select(*by, "activity", "mobility", (F.sqrt(F.col("_v2") / F.col("_v1")) / F.col("mobility")).alias("complexity"))


def night_variability(nights: DataFrame, value: str, by: Sequence[str], order: str = "day") -> DataFrame:
    """Night-to-night CV, slope per night and direction."""
    d = nights.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    g = d.groupBy(*by).agg(
        F.count("*").alias("n"), (F.stddev_samp(value) / F.nullif(F.avg(value), F.lit(0.0)) * 100).alias("cv_pct"), F.regr_slope(F.col(value), F.col("_i")).alias("slope")
    ).where(F.col("n") >= 3)
    return g.withColumn("trend", F.when(F.col("slope") > 0, "improving").when(F.col("slope") < 0, "declining").otherwise("stable"))


# --- information -------------------------------------------------------------

def mutual_information(df: DataFrame, x: str, flag: Column, by: Sequence[str], bins: int = 5) -> DataFrame:
    """Nats between equal-width bins of x and a binary flag, from joint counts."""
    w = Window.partitionBy(*by)
    d = df.where(F.col(x).isNotNull()).withColumn("_y", flag.cast("int"))
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    d = d.withColumn("_b", F.when(hi > lo, F.least(F.floor((F.col(x) - lo) / ((hi - lo) / bins)), F.lit(bins - 1))).otherwise(0))
    c = d.groupBy(*by, "_b", "_y").agg(F.count("*").cast("double").alias("c"))
    n = F.sum("c").over(w)
    px, py = F.sum("c").over(Window.partitionBy(*by, "_b")), F.sum("c").over(Window.partitionBy(*by, "_y"))
    term = c.withColumn("_t", F.col("c") / n * F.log(F.col("c") * n / (px * py)))
    return term.groupBy(*by).agg(F.greatest(F.sum("_t"), F.lit(0.0)).alias("mi"))


def quantile_codes(df: DataFrame, columns: Sequence[str], by: Sequence[str], bins: int = 5) -> DataFrame:
    """Equal-frequency codes on value edges; repeated edges merge, ties stay together."""
    w = Window.partitionBy(*by)
    probs = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    for c in columns:
        edges = F.array_distinct(F.percentile(c, probs).over(w))
        df = df.withColumn(f"_e_{c}", edges)
    for c in columns:
        inner = F.slice(f"_e_{c}", F.lit(2), F.greatest(F.size(f"_e_{c}") - 2, F.lit(0)))
        df = df.withColumn(f"q_{c}", F.size(F.filter(inner, _not_above(c)))).drop(f"_e_{c}")
    return df


def _not_above(c: str):
    return lambda edge: edge <= F.col(c)


def transfer_entropy(daily: DataFrame, metrics: Sequence[str], by: Sequence[str], bins: int = 5, history: int = 3, order: str = "day") -> DataFrame:
    """Bits that the past of x adds about y beyond y's own past, for every ordered metric pair."""
    w = Window.partitionBy(*by).orderBy(order)
    d = quantile_codes(daily.na.drop(subset=list(metrics)), metrics, by, bins)
    for m in metrics:
        past = sum((F.lag(f"q_{m}", k).over(w) * bins ** (k - 1) for k in range(1, history + 1)), F.lit(0))
        d = d.withColumn(f"p_{m}", past)
    pairs = F.array(*[
        F.struct(F.lit(x).alias("source"), F.lit(y).alias("target"), F.col(f"q_{y}").alias("y"), F.col(f"p_{y}").alias("yp"), F.col(f"p_{x}").alias("xp"))
        for x in metrics for y in metrics if x != y
    ])
    keys = [*by, "source", "target"]
    c = d.where(F.col(f"p_{metrics[0]}").isNotNull()).select(*by, F.inline(pairs)).groupBy(*keys, "y", "yp", "xp").agg(F.count("*").cast("double").alias("c"))
    over = lambda *cols: F.sum("c").over(Window.partitionBy(*keys, *cols))
    t = c.withColumn("_t", F.col("c") / over() * F.log2(F.col("c") * over("yp") / (over("yp", "xp") * over("y", "yp"))))
    return t.groupBy(*keys).agg(F.greatest(F.sum("_t"), F.lit(0.0)).alias("te"))


def net_flow(te: DataFrame, by: Sequence[str]) -> DataFrame:
    """te(x -> y) minus te(y -> x)."""
    back = te.select(*by, F.col("source").alias("target"), F.col("target").alias("source"), F.col("te").alias("_b"))
    return te.join(back, [*by, "source", "target"]).withColumn("net", F.col("te") - F.col("_b")).drop("_b")


def permutation_entropy(df: DataFrame, value: str, by: Sequence[str], order: str = "day") -> DataFrame:
    """Normalised entropy of the ordinal patterns of three successive values (earlier wins ties)."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.where(F.col(value).isNotNull()).withColumn("_b", F.lead(value, 1).over(w)).withColumn("_c", F.lead(value, 2).over(w)).where(F.col("_c").isNotNull())
    a, b, c = F.col(value), F.col("_b"), F.col("_c")
    pattern = (a > b).cast("int") * 4 + (a > c).cast("int") * 2 + (b > c).cast("int")
    g = d.groupBy(*by, pattern.alias("pattern")).agg(F.count("*").cast("double").alias("c"))
    p = g.withColumn("_p", F.col("c") / F.sum("c").over(Window.partitionBy(*by)))
    return p.groupBy(*by).agg((-F.sum(F.col("_p") * F.log2("_p")) / F.lit(math.log2(6))).alias("pe"))


def fluctuation(df: DataFrame, value: str, by: Sequence[str], scales: Sequence[int], order: str = "day") -> DataFrame:
    """Detrended fluctuation exponent over the given box sizes with half-overlapping boxes.

    Every point is listed once per box it lies in; the residual of each box comes
    from combining regression sums.
    """
    w = Window.partitionBy(*by).orderBy(order)
    whole = Window.partitionBy(*by)
    d = df.where(F.col(value).isNotNull()).withColumn("_x", F.col(value) - F.avg(value).over(whole))
    d = d.select(*by, (F.row_number().over(w) - 1).alias("_i"), F.count("*").over(whole).alias("_n"),
                 F.sum("_x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_w"))
    d = d.select("*", F.explode(F.array(*[F.lit(s) for s in scales])).alias("scale")).where(F.col("_n") >= F.col("scale") * 4)
    step = F.floor(F.col("scale") / 2).cast("int")
    lo = F.greatest(F.ceil((F.col("_i") - F.col("scale") + 1) / step), F.lit(0))
    hi = F.floor(F.col("_i") / step)
    boxes = d.where(lo <= hi).withColumn("box", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint")))).where(F.col("box") * step < F.col("_n") - F.col("scale"))
    y, x = F.col("_w"), F.col("_i")
    r = boxes.groupBy(*by, "scale", "box").agg(F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_sxx(y, x).alias("sxx"))
    rss = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    f = r.groupBy(*by, "scale").agg(F.avg(F.sqrt(rss / F.col("scale"))).alias("f")).where(F.col("f") > 0)
    return f.groupBy(*by).agg(F.count("*").alias("n_scales"), F.regr_slope(F.log("f"), F.log("scale")).alias("alpha")).where(F.col("n_scales") >= 2)


# --- pair counting on bounded series -----------------------------------------

BLOCK = 256


def series_blocks(df: DataFrame, value: str, by: Sequence[str], order: str = "day", block: int = BLOCK, min_n: int = 10) -> DataFrame:
    """One row per (series, block of its positions); the ordered values ride along as an array."""
    s = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s"))
    s = s.where(F.size("s") >= min_n).select(*by, F.transform("s", lambda x: x["v"]).alias("series"))
    blocks = F.sequence(F.lit(0), F.floor((F.size("series") - 1) / block).cast("int"))
    return s.withColumn("block", F.explode(blocks)).repartition(*by, "block")


def _by_row(fn, by: Sequence[str], out: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*[getattr(r, k) for k in by], *vals) for r in pdf.itertuples(index=False) for vals in fn(np.asarray(r.series, dtype=float), int(r.block))]
            yield pd.DataFrame(rows, columns=[*by, *out])
    return run


def _types(df: DataFrame, by: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in by)


def _match_counts(x: np.ndarray, block: int, m: int, r: float, scale: int):
    """Matches of templates m and m+1 long for a block of template starts; self-matches kept apart."""
    n = len(x) - m
    rows = np.arange(block * BLOCK, min((block + 1) * BLOCK, len(x) - m + 1))
    if n < 1 or len(rows) == 0:
        return None
    near = np.ones((len(rows), len(x) - m + 1), dtype=bool)
    for k in range(m):
        near &= np.abs(x[rows + k][:, None] - x[k:len(x) - m + 1 + k][None, :]) <= r
    inner = rows < n
    longer = near[inner][:, :n] & (np.abs(x[rows[inner] + m][:, None] - x[m:][None, :]) <= r)
    phi_m = np.log(near.mean(axis=1)).sum()
    phi_m1 = np.log(longer.mean(axis=1)).sum()
    b = int(near[inner][:, :n].sum() - inner.sum())
    a = int(longer.sum() - inner.sum())
    return (scale, a, b, float(phi_m), float(phi_m1), int(len(rows)), int(inner.sum()))


def sample_entropy(df: DataFrame, value: str, by: Sequence[str], order: str = "day", m: int = 2, r_factor: float = 0.2, scales: Sequence[int] = (1,), min_n: int = 30) -> DataFrame:
    """Sample and approximate entropy, per coarse-graining scale (Chebyshev, tolerance r_factor x population sd)."""
    scales = tuple(int(s) for s in scales)

    def count(x: np.ndarray, block: int):
        for s in scales:
            k = len(x) // s
            y = x[: k * s].reshape(k, s).mean(axis=1) if k else x[:0]
            if k >= min_n and block * BLOCK < k:
                got = _match_counts(y, block, m, r_factor * y.std(), s)
                if got:
                    yield got

    blocks = series_blocks(df, value, by, order)
    out = ["scale", "a", "b", "phi_m", "phi_m1", "n_m", "n_m1"]
    counted = blocks.mapInPandas(_by_row(count, by, out), f"{_types(blocks, by)}, scale int, a bigint, b bigint, phi_m double, phi_m1 double, n_m bigint, n_m1 bigint")
    g = counted.groupBy(*by, "scale").agg(*[F.sum(c).alias(c) for c in out[1:]])
    return g.select(
        *by, "scale", "a", "b", F.when((F.col("a") > 0) & (F.col("b") > 0), -F.log(F.col("a") / F.col("b"))).alias("sampen"),
        (F.col("phi_m") / F.col("n_m") - F.col("phi_m1") / F.col("n_m1")).alias("apen"),
    )


# Low scales to 5, high ones from 11; limits 0.3, 0.5 and 0.8 of the patterns.
def multiscale_pattern(mse: DataFrame, by: Sequence[str]) -> DataFrame:
    low, high = F.avg(F.when(F.col("scale") <= 5, F.col("sampen"))), F.avg(F.when(F.col("scale") > 10, F.col("sampen")))
    g = mse.groupBy(*by).agg(F.count("sampen").alias("n_scales"), low.alias("low_mean"), high.alias("high_mean"))
    label = (
        F.when(F.col("n_scales") < 10, "insufficient_data").when((F.col("high_mean") < 0.5) & (F.col("low_mean") > 0.5), "neuropathic")
        .when(F.col("low_mean") < 0.3, "severely_reduced").when(F.col("high_mean") > F.col("low_mean") * 0.8, "inflammatory").otherwise("mixed")
    )
    return g.withColumn("pattern", label)


def _runs(flags: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    length = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    return length[length >= 2]


def recurrence(df: DataFrame, value: str, by: Sequence[str], order: str = "day", dim: int = 3, delay: int = 1, threshold: float = 0.10) -> DataFrame:
    """Recurrence rate, determinism, laminarity and diagonal-length entropy of the embedded series."""

    def count(x: np.ndarray, block: int):
        m = len(x) - (dim - 1) * delay
        if m < 10:
            return
        e = np.stack([x[d * delay: d * delay + m] for d in range(dim)], axis=1)
        eps = threshold * x.std(ddof=1)
        mine = range(block * BLOCK, min((block + 1) * BLOCK, m))
        lengths: dict[int, int] = {}
        recur = vertical = 0
        for k in mine:
            near = (np.abs(e - e[k]) <= eps).all(axis=1)
            recur += int(near.sum()) - 1
            vertical += int(_runs(near).sum())
            if k > 0:
                for size in _runs((np.abs(e[k:] - e[:-k]) <= eps).all(axis=1)):
                    lengths[int(size)] = lengths.get(int(size), 0) + 1
        yield (0, 0, recur, vertical, len(mine))
        for size, c in lengths.items():
            yield (size, c, 0, 0, 0)

    blocks = series_blocks(df, value, by, order)
    out = ["length", "c", "recur", "vertical", "rows_n"]
    counted = blocks.mapInPandas(_by_row(count, by, out), f"{_types(blocks, by)}, length int, c bigint, recur bigint, vertical bigint, rows_n bigint")
    per = counted.groupBy(*by, "length").agg(*[F.sum(c).alias(c) for c in out[1:]])
    w = Window.partitionBy(*by)
    share = F.col("c") / F.nullif(F.sum("c").over(w), F.lit(0))
    g = per.withColumn("_h", F.when(F.col("c") > 0, -share * F.log2(share)).otherwise(0.0)).groupBy(*by).agg(
        F.sum("recur").alias("recurrences"), F.sum("vertical").alias("_v"), F.sum(F.col("length") * F.col("c")).alias("_d"), F.sum("rows_n").alias("m"), F.sum("_h").alias("diagonal_entropy")
    )
    m, n = F.col("m"), F.nullif(F.col("recurrences"), F.lit(0))
    return g.select(
        *by, "m", "recurrences", (F.col("recurrences") / (m * m - m)).alias("rate"), F.coalesce(F.col("_d") / (n / 2), F.lit(0.0)).alias("determinism"),
        F.coalesce(F.col("_v") / n, F.lit(0.0)).alias("laminarity"), "diagonal_entropy",
    )
