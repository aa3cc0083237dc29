"""Bootstrap intervals whose draws depend only on (replicate, draw, seed).

The draws are integer arithmetic, so a result is the same on any partitioning
and can be replayed elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .complexity import _types

PRIME = 2147483647
#: Replicates that are computed from one copy of a series.
CHUNK = 50


def draw(rep: Column, i: Column, seed: int) -> Column:
    """Pseudo-random integer below 2^31 - 1 by quadratic mixing of BIGINTs."""
    p = F.lit(PRIME).cast("bigint")
    x0 = F.pmod(rep.cast("bigint") * 1000003 + i.cast("bigint") * 7919 + F.lit(seed * 104729).cast("bigint"), p)
    x1 = F.pmod(x0 * 48271 + 11, p)
    x2 = F.pmod(x1 * x1 + x0, p)
    return F.pmod(x2 * x2 + x1, p)


def draw_sql(rep: str, i: str, seed: int) -> str:
    x0 = f"(({rep}*1000003+{i}*7919+{seed * 104729})%{PRIME})"
    x1 = f"(({x0}*48271+11)%{PRIME})"
    x2 = f"(({x1}*{x1}+{x0})%{PRIME})"
    return f"(({x2}*{x2}+{x1})%{PRIME})"


def draws(reps: np.ndarray, i: np.ndarray, seed: int) -> np.ndarray:
    """The same integers as ``draw``, one row for each replicate; no product leaves 64 bits."""
    x0 = (reps[:, None] * 1000003 + i[None, :] * 7919 + seed * 104729) % PRIME
    x1 = (x0 * 48271 + 11) % PRIME
    x2 = (x1 * x1 + x0) % PRIME
    return (x2 * x2 + x1) % PRIME


def _drawn(x: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """As many draws with replacement as the series holds, a row for each replicate."""
    return x[draws(reps, np.arange(len(x)), seed) % len(x)]


def _replicates(series: DataFrame, by: Sequence[str], reps: int, stat: Callable[..., np.ndarray], kind: str = "double") -> DataFrame:
    """One row (by, rep, stat) for each replicate; ``stat`` gets the numbers of CHUNK replicates and the array columns.

    A series is copied once per CHUNK replicates, not once for each.
    """
    start = F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(CHUNK)))
    blocks = series.withColumn("_from", start).repartition(*by, "_from")
    arrays = [c for c in series.columns if c not in by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                numbers = np.arange(row["_from"], min(row["_from"] + CHUNK, reps))
                out = stat(numbers, *(np.asarray(row[c], dtype=float) for c in arrays))
                yield pd.DataFrame({**{k: [row[k]] * len(numbers) for k in by}, "rep": numbers, "stat": list(out)})

    return blocks.mapInPandas(run, f"{_types(series, by)}, rep int, stat {kind}")


def _interval(reps: DataFrame, by: Sequence[str], stat: str, level: float) -> DataFrame:
    a = (1 - level) / 2
    return reps.groupBy(*by).agg(
        F.percentile(stat, F.lit(a)).alias("ci_lo"), F.percentile(stat, F.lit(1 - a)).alias("ci_hi"),
        F.avg(stat).alias("boot_mean"), F.stddev_samp(stat).alias("boot_sd"),
    )


def _ordered(value: str, day: str, keep: Column) -> Column:
    s = F.array_sort(F.collect_list(F.when(keep & F.col(value).isNotNull(), F.struct(F.col(day).alias("d"), F.col(value).alias("v")))))
    return F.transform(s, lambda x: x["v"])


def bootstrap_mean_diff(signals: DataFrame, by: Sequence[str], first: Column, reps: int = 1000, level: float = 0.95, seed: int = 42, value: str = "value", day: str = "day") -> DataFrame:
    """Percentile interval of mean(others) - mean(first).

    One series (one value per day) travels as an array, once per block of replicates, which are
    computed in place: no index join and no shuffle of resampled values.
    """
    g = signals.groupBy(*by).agg(_ordered(value, day, first).alias("_a"), _ordered(value, day, ~first).alias("_b"))
    stat = lambda reps, a, b: _drawn(b, reps, seed + 1).mean(axis=1) - _drawn(a, reps, seed).mean(axis=1)
    return _interval(_replicates(g.where((F.size("_a") > 1) & (F.size("_b") > 1)), by, reps, stat), by, "stat", level)


def block_bootstrap(signals: DataFrame, by: Sequence[str], block: int = 7, reps: int = 1000, level: float = 0.95, seed: int = 42, value: str = "value", day: str = "day") -> DataFrame:
    """Moving-block interval of the mean: whole blocks are drawn, so autocorrelation survives."""
    g = signals.groupBy(*by).agg(_ordered(value, day, F.lit(True)).alias("_a"))

    def stat(reps: np.ndarray, x: np.ndarray) -> np.ndarray:
        i = np.arange(len(x))
        return x[draws(reps, i // block, seed) % (len(x) - block + 1) + i % block].mean(axis=1)

    return _interval(_replicates(g.where(F.size("_a") > block), by, reps, stat), by, "stat", level)


#: What a path x -> m -> y is described by: m on x, y on m beside x, y on x, y on x beside m, and a * b.
PATH_TERMS = ("a", "b", "c", "c_prime", "indirect")


def path_terms(gram: np.ndarray, n: int, x: int, m: int, y: int) -> np.ndarray:
    """PATH_TERMS of each replicate from its Gram matrix of (1, columns); undefined ones are NaN."""
    cov = lambda i, j: gram[:, i + 1, j + 1] - gram[:, 0, i + 1] * gram[:, 0, j + 1] / n
    vx, vm, xm, xy, my = cov(x, x), cov(m, m), cov(x, m), cov(x, y), cov(m, y)
    det = vx * vm - xm * xm
    with np.errstate(divide="ignore", invalid="ignore"):
        a, c = xm / vx, xy / vx
        b, rest = (my * vx - xy * xm) / det, (xy * vm - my * xm) / det
    return np.stack([a, b, c, rest, a * b], axis=1)


def bootstrap_paths(daily: DataFrame, paths: Sequence[tuple[str, str, str]], by: Sequence[str], reps: int = 1000, level: float = 0.95, seed: int = 42, day: str = "day") -> DataFrame:
    """by, path, term, ci_lo, ci_hi, p for the terms of several paths x -> m -> y, all from the same draws of days.

    A replicate is a weight for each day, and a weighted Gram matrix of all columns gives every path's terms: slopes,
    both effects and the indirect one.  Days without a value in any column go.  p is twice the smaller share of replicates on one side of 0.
    """
    by = list(by)
    columns = sorted({c for p in paths for c in p})
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    rows = F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), *[F.col(c).cast("double").alias(c) for c in columns])))
    part = lambda c: F.transform("_r", lambda r: r[c]).alias(c)
    series = daily.where(whole).groupBy(*by).agg(rows.alias("_r")).where(F.size("_r") > 2).select(*by, *[part(c) for c in columns])

    def stat(numbers: np.ndarray, *values: np.ndarray) -> np.ndarray:
        n = len(values[0])
        x = np.stack([np.ones(n), *(v - v.mean() for v in values)], axis=1)
        picked = draws(numbers, np.arange(n), seed) % n
        weight = np.stack([np.bincount(p, minlength=n) for p in picked]).astype(float)
        gram = (weight @ (x[:, :, None] * x[:, None, :]).reshape(n, -1)).reshape(len(numbers), x.shape[1], x.shape[1])
        return np.concatenate([path_terms(gram, n, *(columns.index(c) for c in p)) for p in paths], axis=1)

    values = _replicates(series, by, reps, stat, "array<double>")
    names = F.array(*[F.struct(F.lit("->".join(p)).alias("path"), F.lit(t).alias("term")) for p in paths for t in PATH_TERMS])
    long = values.select(*by, F.inline(F.arrays_zip(names.alias("what"), F.col("stat")))).where(~F.isnan("stat"))
    ends = long.groupBy(*by, F.col("what.path").alias("path"), F.col("what.term").alias("term"))
    a = (1 - level) / 2
    sides = F.least(F.avg((F.col("stat") <= 0).cast("double")), F.avg((F.col("stat") >= 0).cast("double")))
    return ends.agg(F.percentile("stat", F.lit(a)).alias("ci_lo"), F.percentile("stat", F.lit(1 - a)).alias("ci_hi"), F.least(2 * sides, F.lit(1.0)).alias("p"))


def bootstrap_stat(signals: DataFrame, by: Sequence[str], stat: Callable[[Column], Column], reps: int = 1000, level: float = 0.95, seed: int = 42, value: str = "value", day: str = "day") -> DataFrame:
    """Interval of any aggregate Column, e.g. ``F.median``: draws become rows of (series, replicate)."""
    g = signals.groupBy(*by).agg(_ordered(value, day, F.lit(True)).alias("_a"))
    values = _replicates(g.where(F.size("_a") > 0), by, reps, lambda reps, x: _drawn(x, reps, seed), "array<double>")
    drawn = values.select(*by, "rep", F.explode("stat").alias("_v"))
    return _interval(drawn.groupBy(*by, "rep").agg(stat(F.col("_v")).alias("stat")), by, "stat", level)


#: Cumulative Poisson(1) probabilities scaled to the draw range.
_POISSON = []
_p = _c = 2.718281828459045 ** -1
for _k in range(1, 12):
    _POISSON.append(int(_c * PRIME))
    _p /= _k
    _c += _p


def poisson_bootstrap_mean(samples: DataFrame, by: Sequence[str], row_id: str, reps: int = 200, level: float = 0.95, seed: int = 42, value: str = "value") -> DataFrame:
    """Interval of a mean over groups of any size.

    Each row gets an independent Poisson(1) weight per replicate, so replicates
    are combining sums and nothing of a group has to meet in one task.
    """
    d = samples.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_d", draw(F.col("rep"), F.col(row_id), seed))
    weight = sum(((F.col("_d") >= t).cast("int") for t in _POISSON), F.lit(0))
    g = d.withColumn("_w", weight).groupBy(*by, "rep").agg((F.sum(F.col("_w") * F.col(value)) / F.nullif(F.sum("_w"), F.lit(0))).alias("stat"))
    return _interval(g, by, "stat", level)
