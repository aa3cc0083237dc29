"""Changepoints: consensus, before/after windows, segments, and two model-based detectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gaps import islands
from .joins import tolerance_join


def battery(frames: dict[str, DataFrame], by: Sequence[str] = ("entity_id", "metric"), day: str = "day") -> DataFrame:
    """Detections of several methods as long rows."""
    out = None
    for method, f in frames.items():
        part = f.select(*by, day, F.lit(method).alias("method"))
        out = part if out is None else out.unionByName(part)
    return out


def consensus(detections: DataFrame, by: Sequence[str] = ("entity_id",), day: str = "day", tolerance: int = 3) -> DataFrame:
    """Clusters of detection days at most ``tolerance`` apart: middle day, and score = methods + metrics involved."""
    by = list(by)
    d = islands(detections, by, day, tolerance)
    inside = Window.partitionBy(*by, "island")
    d = d.withColumn("_k", F.dense_rank().over(inside.orderBy(day)) - 1)
    d = d.withColumn("_mid", F.floor((F.max("_k").over(inside) + 1) / 2))
    g = d.groupBy(*by, "island").agg(
        F.max(F.when(F.col("_k") == F.col("_mid"), F.col(day))).alias("date"), F.count_distinct("method").alias("n_methods"), F.count_distinct("metric").alias("n_metrics"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"),
    )
    return g.drop("island").withColumn("score", F.col("n_methods") + F.col("n_metrics")).withColumn("high_confidence", F.col("score") >= 3)


def convergence(wide_z: DataFrame, zcols: Sequence[str], limit: float = 1.5) -> DataFrame:
    """How many metrics are extreme on each day."""
    n = F.lit(0)
    for c in zcols:
        n = n + F.coalesce((F.abs(c) > limit).cast("int"), F.lit(0))
    return wide_z.withColumn("convergence", n)


def before_after(signals: DataFrame, points: DataFrame, by: Sequence[str] = ("entity_id",), day: str = "day", reach: int = 14) -> DataFrame:
    """Per changepoint and metric: mean, sd and n of the 14 days before and from the day on, with change."""
    by = list(by)
    near = tolerance_join(points.select(*by, day), signals, by, reach, day)
    early = F.col("offset_days") < 0
    a, b = F.when(early, F.col("value")), F.when(~early, F.col("value"))
    g = near.groupBy(*by, day, "metric").agg(
        F.avg(a).alias("before_mean"), F.avg(b).alias("after_mean"), F.stddev_samp(a).alias("before_sd"), F.stddev_samp(b).alias("after_sd"), F.count(a).alias("before_n"), F.count(b).alias("after_n")
    )
    delta = F.col("after_mean") - F.col("before_mean")
    return g.withColumn("delta", delta).withColumn("pct", F.coalesce(delta / F.nullif(F.abs("before_mean"), F.lit(0.0)) * 100, F.lit(0.0)))


# An artifact lies within 3 days of a gap, a genuine shift beyond 14 with two metrics moved by 10 percent.
def classify_points(shifts: DataFrame, distances: DataFrame, by: Sequence[str] = ("entity_id",), day: str = "day", artifact_days: int = 3, reach: int = 14) -> DataFrame:
    """Top mover per changepoint and its class: near a data gap, a clear shift far from gaps, or to be looked at."""
    g = shifts.groupBy(*by, day).agg(
        F.max_by("metric", F.struct(F.round(F.abs("pct"), 9), "metric")).alias("top_metric"), F.max(F.abs("pct")).alias("top_pct"), F.count_if(F.abs("pct") > 10).alias("n_shifted")
    )
    far = F.coalesce(F.col("distance_days"), F.lit(999999))
    label = F.when(far <= artifact_days, "ARTIFACT").when((far > reach) & (F.col("n_shifted") >= 2), "GENUINE").otherwise("INVESTIGATE")
    return g.join(distances, [*by, day], "left").withColumn("validation", label)


def segments(signals: DataFrame, by: Sequence[str], day: str = "day", min_gap: int = 3, min_rows: int = 3) -> DataFrame:
    """Statistics of the stretches between data gaps."""
    g = islands(signals, by, day, min_gap).groupBy(*by, "island").agg(
        F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )
    return g.where(F.col("n") >= min_rows)


def named_windows(signals: DataFrame, windows: DataFrame, by: Sequence[str] = ("metric",), day: str = "day") -> DataFrame:
    """Means per named date range; the few ranges are listed day by day, so the join is an equality."""
    days = windows.select("label", F.explode(F.sequence("first_day", "last_day")).alias(day))
    return signals.join(days, day).groupBy(*by, "label").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


# --- model-based detectors on one bounded series -----------------------------

def _standard(x: np.ndarray) -> np.ndarray:
    sd = x.std()
    return (x - x.mean()) / (sd if sd > 0 else 1.0)


def run_length_probabilities(x: np.ndarray, hazard: float, recent: int = 0, prune: float = 1e-18) -> np.ndarray:
    """Posterior mass of runs no longer than ``recent`` after each value (Normal-Gamma model).

    With ``recent=0`` this is the mass of a run that starts now, which under a
    constant hazard never moves; a positive ``recent`` shows a collapse of the run length.

    Runs whose mass falls below ``prune`` are dropped, which bounds the work per
    step without touching the result at double precision.
    """
    n = len(x)
    gammas = np.array([math.lgamma(1 + 0.5 * k + 0.5) - math.lgamma(1 + 0.5 * k) for k in range(n + 1)])
    age = np.array([0])
    mass, mu, beta = np.array([1.0]), np.array([0.0]), np.array([1.0])
    out = np.zeros(n)
    for t in range(n):
        kappa, alpha = 1.0 + age, 1.0 + 0.5 * age
        var = np.maximum(beta * (kappa + 1) / (alpha * kappa), 1e-10)
        nu = 2 * alpha
        dens = np.exp(gammas[age] - 0.5 * np.log(nu * math.pi * var) - (nu + 1) / 2 * np.log1p((x[t] - mu) ** 2 / (nu * var)))
        joint = mass * dens
        grown, fresh = joint * (1 - hazard), joint.sum() * hazard
        total = grown.sum() + fresh
        if total > 0:
            grown, fresh = grown / total, fresh / total
        out[t] = fresh + (grown[age + 1 <= recent].sum() if t >= recent else 0.0)
        keep = grown > prune
        nb = beta + kappa * (x[t] - mu) ** 2 / (2 * (kappa + 1))
        nm = (kappa * mu + x[t]) / (kappa + 1)
        age = np.concatenate(([0], age[keep] + 1))
        mass = np.concatenate(([fresh], grown[keep]))
        mu, beta = np.concatenate(([0.0], nm[keep])), np.concatenate(([1.0], nb[keep]))
    return out


def optimal_segments(x: np.ndarray, penalty: float, min_size: int = 5) -> list[int]:
    """Starts of later segments under squared-error cost plus a penalty per segment (pruned exact search)."""
    n = len(x)
    s1, s2 = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(x * x)))
    cost = lambda a, b: s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (b - a)
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    last = np.zeros(n + 1, dtype=int)
    open_ = np.array([0])
    for b in range(min_size, n + 1):
        ok = open_[(b - open_ >= min_size) & np.isfinite(best[open_])]
        if len(ok) == 0:
            continue
        c = best[ok] + cost(ok, b)
        best[b] = c.min() + penalty
        last[b] = ok[int(c.argmin())]
        dead = ok[c > best[b]]
        open_ = np.concatenate((np.setdiff1d(open_, dead), [b - min_size + 1]))
    out, b = [], n
    while b > 0 and last[b] > 0:
        out.append(int(last[b]))
        b = last[b]
    return sorted(out)


def _per_series(signals: DataFrame, by: Sequence[str], day: str, value: str, fn, extra: str) -> DataFrame:
    by = list(by)
    kinds = dict(signals.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day, kind="stable")
        rows = fn(pdf[value].to_numpy(dtype=float)) if len(pdf) >= 10 else []
        names = [e.split()[0] for e in extra.split(", ")]
        out = pd.DataFrame([r[1:] for r in rows], columns=names)
        for k in by:
            out[k] = pd.Series([pdf[k].iloc[0]] * len(rows), dtype=object)
        out[day] = pd.Series([pdf[day].iloc[r[0]] for r in rows], dtype=object)
        return out[[*by, day, *names]]

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, day]) + ", " + extra
    return signals.where(F.col(value).isNotNull()).select(*by, day, value).groupBy(*by).applyInPandas(run, schema)


def bayesian_changepoints(signals: DataFrame, by: Sequence[str] = ("entity_id", "metric"), day: str = "day", value: str = "value", hazard: float = 1 / 30, threshold: float = 0.3, recent: int = 3) -> DataFrame:
    def fn(x):
        p = run_length_probabilities(_standard(x), hazard, recent)
        return [(i, float(v)) for i, v in enumerate(p) if v > threshold]

    return _per_series(signals, by, day, value, fn, "probability double")


def segmentation(signals: DataFrame, by: Sequence[str] = ("entity_id", "metric"), day: str = "day", value: str = "value", min_size: int = 5, weight: float = 2.0) -> DataFrame:
    def fn(x):
        z = _standard(x)
        penalty = weight * math.log(len(z)) * max(float(z.var()), 0.1)
        return [(i, i) for i in optimal_segments(z, penalty, min_size)]

    return _per_series(signals, by, day, value, fn, "position int")
