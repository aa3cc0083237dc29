"""Anomaly voting, ensembles, discords, isolation, clustering and fingerprints.

Wide inputs have one row per entity and day.  Models are fitted per entity on
that calendar-bounded frame, so entities spread over the cluster and no model
ever sees an unbounded group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .complexity import BLOCK, _by_row, _types, series_blocks
from .windows import z_score

# Ensemble weights.
VOTE_WEIGHTS = {"z": 0.35, "forest": 0.40, "percentile": 0.25}
METHOD_WEIGHTS = {"matrix_profile": 0.20, "isolation_forest": 0.25, "reconstruction": 0.20, "spc": 0.20, "night_features": 0.15}


def zcol(m: str) -> str:
    return f"z_{m}"


def with_z(wide: DataFrame, metrics: Sequence[str], by: Sequence[str], baseline: Column | None = None) -> DataFrame:
    """A z column per metric; all share one window partitioning."""
    return wide.select("*", *[z_score(m, by, baseline).alias(zcol(m)) for m in metrics])


def _sum(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def z_vote(wide_z: DataFrame, metrics: Sequence[str], limit: float = 2.0, votes: int = 3) -> DataFrame:
    """At least three metrics beyond the limit, or a mean |z| beyond it."""
    size = [F.abs(zcol(m)) for m in metrics]
    n = _sum([F.coalesce((s > limit).cast("int"), F.lit(0)) for s in size])
    known = _sum([s.isNotNull().cast("int") for s in size])
    mean = _sum([F.coalesce(s, F.lit(0.0)) for s in size]) / F.nullif(known, F.lit(0))
    d = wide_z.withColumn("n_extreme", n).withColumn("mean_abs_z", mean)
    return d.withColumn("z_anomaly", (F.col("n_extreme") >= votes) | F.coalesce(F.col("mean_abs_z") > limit, F.lit(False)))


def percentile_vote(wide: DataFrame, metrics: Sequence[str], by: Sequence[str], votes: int = 3, min_n: int = 5) -> DataFrame:
    """At least three metrics outside their own 5th-95th percentile."""
    w = Window.partitionBy(*by)
    tails = F.array(F.lit(0.05), F.lit(0.95))
    d = wide.select("*", *[F.when(F.count(m).over(w) >= min_n, F.percentile(m, tails).over(w)).alias(f"_q_{m}") for m in metrics])
    out = [F.coalesce(((F.col(m) < F.col(f"_q_{m}")[0]) | (F.col(m) > F.col(f"_q_{m}")[1])).cast("int"), F.lit(0)) for m in metrics]
    d = d.withColumn("n_outside", _sum(out)).drop(*[f"_q_{m}" for m in metrics])
    return d.withColumn("pct_anomaly", F.col("n_outside") >= votes)


def vote_ensemble(d: DataFrame, n_metrics: int) -> DataFrame:
    """Two of three methods agree; weighted score of their magnitudes."""
    votes = F.col("z_anomaly").cast("int") + F.col("forest_anomaly").cast("int") + F.col("pct_anomaly").cast("int")
    w = VOTE_WEIGHTS
    score = w["z"] * F.col("mean_abs_z") + w["forest"] * F.col("forest_score") + w["percentile"] * F.col("n_outside") / n_metrics
    return d.withColumn("votes", votes).withColumn("anomaly", F.col("votes") >= 2).withColumn("score", score)


def method_ensemble(scores: DataFrame, weights: dict[str, float] = METHOD_WEIGHTS, by: Sequence[str] = ("entity_id", "day")) -> DataFrame:
    """Long (entity, day, method, score) to one score: best per method, then weights of the methods present."""
    best = scores.where(F.col("score").isNotNull()).groupBy(*by, "method").agg(F.max("score").alias("score"))
    w = F.lit(0.15)
    for name, weight in weights.items():
        w = F.when(F.col("method") == name, F.lit(weight)).otherwise(w)
    return best.withColumn("_w", w).groupBy(*by).agg((F.sum(F.col("score") * F.col("_w")) / F.sum("_w")).alias("score"), F.count("*").alias("n_methods"))


def method_agreement(scores: DataFrame, events: DataFrame, reach: int = 1, share: float = 0.9, by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Did each method put a day near the known event into its top decile?"""
    w = Window.partitionBy(*by, "method")
    top = scores.withColumn("_cut", F.percentile("score", F.lit(share)).over(w)).where(F.col("score") >= F.col("_cut"))
    near = top.join(events, list(by)).where(F.abs(F.datediff("day", "event_date")) <= reach)
    hits = near.groupBy(*by, "method").agg(F.count("*").alias("hits"))
    return scores.select(*by, "method").distinct().join(hits, [*by, "method"], "left").select(*by, "method", F.col("hits").isNotNull().alias("detected"))


# --- discords ----------------------------------------------------------------

def matrix_profile(df: DataFrame, value: str, by: Sequence[str], m: int, order: str = "day") -> DataFrame:
    """Distance of every z-normalised subsequence to its nearest one outside the exclusion zone.

    Rows of the profile are computed in blocks of one bounded series; no pair of
    subsequences ever becomes a row.
    """
    zone = math.ceil(m / 4)

    def profile(x: np.ndarray, block: int):
        win = np.lib.stride_tricks.sliding_window_view(x, m)
        sd = win.std(axis=1)
        flat = sd < 1e-12
        z = (win - win.mean(axis=1, keepdims=True)) / np.where(flat, 1.0, sd)[:, None]
        k = len(win)
        for i in range(block * BLOCK, min((block + 1) * BLOCK, k)):
            d2 = 2.0 * (m - z @ z[i])
            d2 = np.where(flat != flat[i], float(m), np.where(flat & flat[i], 0.0, d2))
            d2[max(0, i - zone): i + zone + 1] = np.inf
            best = d2.min()
            if np.isfinite(best):
                yield (i, float(math.sqrt(max(best, 0.0))))

    blocks = series_blocks(df, value, by, order, min_n=m + 1)
    got = blocks.mapInPandas(_by_row(profile, by, ["pos", "distance"]), f"{_types(blocks, by)}, pos int, distance double")
    days = df.where(F.col(value).isNotNull()).select(*by, order, (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).alias("pos"))
    w = Window.partitionBy(*by)
    lo, hi = F.min("distance").over(w), F.max("distance").over(w)
    score = F.when(hi > lo, (F.col("distance") - lo) / (hi - lo)).otherwise(0.0)
    return got.withColumn("score", score).join(days, [*by, "pos"])


# --- reconstruction ----------------------------------------------------------

def summed_outer(rows: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """(by, n, sums, gram) of the vectors of each group: tasks add up outer products, Spark adds up the tasks.

    However many rows a group has, a task sends one matrix for it, and the result is one row.
    """
    by = list(by)
    kinds = _types(rows, by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(by, sort=False, dropna=False):
                x = np.stack(part[vector].to_numpy())
                out.append((*key, float(len(x)), np.concatenate([x.sum(axis=0), (x.T @ x).ravel()])))
            if out:
                yield pd.DataFrame(out, columns=[*by, "n", "cells"])

    parts = rows.select(*by, vector).mapInPandas(run, f"{kinds}, n double, cells array<double>")
    each = parts.select(*by, "n", F.posexplode("cells").alias("at", "cell")).groupBy(*by, "at").agg(F.sum("n").alias("n"), F.sum("cell").alias("cell"))
    return each.groupBy(*by).agg(F.max("n").cast("bigint").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("at", "cell"))), lambda c: c["cell"]).alias("cells"))


def window_basis(windows: DataFrame, by: Sequence[str], vector: str = "_win") -> DataFrame:
    """(by, n, mean, sd, axes, variances): principal axes of standardized windows, largest variance first."""
    moments = summed_outer(windows, by, vector)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                cells, n = np.asarray(r["cells"], dtype=float), r["n"]
                d = round((math.sqrt(1 + 4 * len(cells)) - 1) / 2)
                mean = cells[:d] / n
                cov = cells[d:].reshape(d, d) / n - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 0))
                sd = np.where(sd > 1e-9 * (1 + np.abs(mean)), sd, 1.0)
                val, vec = np.linalg.eigh(cov / sd[:, None] / sd[None, :])
                out.append((*[r[c] for c in by], n, mean, sd, list(vec.T[::-1]), val[::-1]))
            yield pd.DataFrame(out, columns=[*by, "n", "mean", "sd", "axes", "variances"])

    return moments.mapInPandas(fit, f"{_types(moments, list(by))}, n bigint, mean array<double>, sd array<double>, axes array<array<double>>, variances array<double>")


def windows_of(wide: DataFrame, columns: Sequence[str], train: Column, by: Sequence[str], day: str, width: int) -> DataFrame:
    """(by, day, _win, trained): the cells of each ``width`` rows, and whether all of them are training rows."""
    frame = Window.partitionBy(*by).orderBy(day).rowsBetween(-(width - 1), 0)
    cells = F.array(*[F.col(c).cast("double") for c in columns])
    d = wide.na.drop(subset=list(columns)).withColumn("_win", F.flatten(F.collect_list(cells).over(frame))).withColumn("_train", F.min(train.cast("int")).over(frame))
    return d.where(F.size("_win") == width * len(columns)).select(*by, day, "_win", (F.col("_train") == 1).alias("trained"))


def window_reconstruction(wide: DataFrame, columns: Sequence[str], train: Column, by: Sequence[str] = ("entity_id",), day: str = "day", width: int = 7, k: int = 4, sigmas: float = 2.0) -> DataFrame:
    """Squared error of each 7-row window after projection on the leading components of the training windows.

    The basis comes from summed outer products of the training windows; every window is then scored where it is, as the
    axes are orthonormal: what is left of a window is its length less its projections.  A group with ``k`` training
    windows or fewer has no basis: its errors are NULL and its status is ``too_few``.
    """
    by = list(by)
    d = windows_of(wide, columns, train, by, day, width)
    basis = window_basis(d.where("trained"), by)
    j = d.join(basis, by, "left").withColumn("status", F.when(F.col("n") > k, "ok").otherwise("too_few"))
    z = F.transform("_win", lambda x, i: (x - F.get("mean", i)) / F.get("sd", i))
    j = j.withColumn("_z", F.when(F.col("status") == "ok", z))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    taken = F.aggregate(F.slice("axes", 1, k), F.lit(0.0), lambda t, v: t + F.pow(dot(F.col("_z"), v), F.lit(2.0)))
    left = F.greatest(dot(F.col("_z"), F.col("_z")) - taken, F.lit(0.0)) / F.size("_z")
    out = j.select(*by, day, F.when(F.col("status") == "ok", left).alias("error"), "trained", "status")
    e = F.when(F.col("trained"), F.col("error"))
    p = Window.partitionBy(*by)
    return out.withColumn("threshold", F.avg(e).over(p) + sigmas * F.stddev_pop(e).over(p)).withColumn("anomaly", F.col("error") > F.col("threshold"))


# --- clustering --------------------------------------------------------------

def night_features(samples: DataFrame, by: Sequence[str], value: str = "value", min_n: int = 2) -> DataFrame:
    """Minimal distribution features per night from a histogram of readings."""
    n, v = F.col("_n"), F.col(value)
    hist = samples.groupBy(*by, value).agg(F.count("*").alias("_n"))
    g = hist.groupBy(*by).agg(
        F.sum("_n").alias("length"), F.sum(n * v).alias("sum"), F.sum(n * v * v).alias("_q"),
        F.percentile(value, F.lit(0.5), F.col("_n")).alias("median"), F.max(value).alias("maximum"), F.min(value).alias("minimum"),
    ).where(F.col("length") >= min_n)
    mean = F.col("sum") / F.col("length")
    var = F.greatest(F.col("_q") / F.col("length") - mean * mean, F.lit(0.0))
    return g.select(*by, "sum", "median", mean.alias("mean"), "length", F.sqrt(var).alias("sd"), var.alias("variance"), F.sqrt(F.col("_q") / F.col("length")).alias("rms"), "maximum", "minimum")


def cluster_profiles(labelled: DataFrame, wide: DataFrame, columns: Sequence[str], by: Sequence[str] = ("entity_id",), day: str = "day") -> DataFrame:
    """Centroid and size per cluster, named after its largest |mean z|."""
    j = labelled.where(F.col("cluster") >= 0).join(wide, [*by, day])
    g = j.groupBy(*by, "cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
    lead = F.element_at(F.sort_array(F.array(*[F.struct(F.abs(c).alias("s"), F.lit(c).alias("c")) for c in columns]), asc=False), 1)["c"]
    return g.withColumn("leading", lead)


def principal_axes(wide: DataFrame, columns: Sequence[str], by: Sequence[str] = ("entity_id",), k: int = 2) -> DataFrame:
    """Loadings, explained share and variance of the first k components per entity.

    The covariance is a combining aggregate over any number of rows; only the
    small matrix (one row per entity) is decomposed.
    """
    columns, by = list(columns), list(by)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    filled = wide.na.fill(0.0, subset=columns)
    g = filled.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).alias("cov"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                m = np.zeros((len(columns), len(columns)))
                for (i, j), c in zip(pairs, r.cov):
                    m[i, j] = m[j, i] = c
                val, vec = np.linalg.eigh(m)
                for a in range(min(k, len(columns))):
                    v = vec[:, -1 - a]
                    v = v * (1 if v[np.argmax(np.abs(v))] > 0 else -1)
                    for name, x in zip(columns, v):
                        rows.append((*[getattr(r, b) for b in by], a + 1, name, float(x), float(val[-1 - a] / max(val.sum(), 1e-300)), float(val[-1 - a])))
            yield pd.DataFrame(rows, columns=[*by, "axis", "metric", "loading", "explained", "variance"])

    return g.where("n > 1").mapInPandas(run, f"{_types(g, by)}, axis int, metric string, loading double, explained double, variance double")


# --- fingerprints ------------------------------------------------------------

def fingerprint(anomalies: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Mean z and mean |z| per metric over anomaly days, with the metric's rank (largest |z| first)."""
    g = anomalies.groupBy(*by).agg(F.count("*").alias("n_days"), *[F.struct(F.avg(zcol(m)).alias("z"), F.avg(F.abs(zcol(m))).alias("a")).alias(m) for m in metrics])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m)["z"].alias("mean_z"), F.col(m)["a"].alias("mean_abs_z")) for m in metrics])
    long = g.select(*by, "n_days", F.inline(rows))
    return long.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.round("mean_abs_z", 9).desc())))


def cosine(prints: DataFrame, pairs: DataFrame, entity: str = "entity_id", value: str = "mean_z") -> DataFrame:
    """Cosine of two entities' vectors for the named (left_id, right_id) pairs."""
    a = prints.select(F.col(entity).alias("left_id"), "metric", F.col(value).alias("a"))
    b = prints.select(F.col(entity).alias("right_id"), "metric", F.col(value).alias("b"))
    j = pairs.join(a, "left_id").join(b, ["right_id", "metric"])
    g = j.groupBy("left_id", "right_id").agg(F.sum(F.col("a") * F.col("b")).alias("_d"), F.sum(F.col("a") * F.col("a")).alias("_a"), F.sum(F.col("b") * F.col("b")).alias("_b"))
    return g.select("left_id", "right_id", F.coalesce(F.col("_d") / F.nullif(F.sqrt(F.col("_a") * F.col("_b")), F.lit(0.0)), F.lit(0.0)).alias("cosine"))


def co_occurrence(anomalies: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("entity_id",), limit: float = 1.5, k: int = 10) -> DataFrame:
    """Share of anomaly days on which both metrics of a registry pair are extreme; strongest pairs first."""
    hot = {m: F.coalesce(F.abs(zcol(m)) > limit, F.lit(False)) for m in metrics}
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1:]]
    g = anomalies.groupBy(*by).agg(F.count("*").alias("n_days"), *[F.count_if(hot[a] & hot[b]).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"_{i}").alias("n_both")) for i, (a, b) in enumerate(pairs)])
    long = g.select(*by, "n_days", F.inline(rows)).withColumn("share", F.col("n_both") / F.col("n_days"))
    w = Window.partitionBy(*by).orderBy(F.desc("n_both"), "metric_a", "metric_b")
    return long.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def gap_gini(anomalies: DataFrame, by: Sequence[str] = ("entity_id",), day: str = "day") -> DataFrame:
    """Gini of the gaps between anomaly days; needs three days."""
    w = Window.partitionBy(*by).orderBy(day)
    gaps = anomalies.select(*by, F.datediff(day, F.lag(day).over(w)).alias("gap")).where(F.col("gap").isNotNull())
    r = gaps.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("gap")))
    g = r.groupBy(*by).agg(F.count("*").alias("n"), F.sum("gap").alias("s"), F.sum(F.col("_i") * F.col("gap")).alias("k")).where(F.col("n") >= 2)
    n = F.col("n")
    return g.select(*by, n.alias("n_gaps"), F.when(F.col("s") > 0, (2 * F.col("k") - (n + 1) * F.col("s")) / (n * F.col("s"))).otherwise(0.0).alias("gini"))


def top_anomalies(scored: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("entity_id",), day: str = "day", k: int = 10, top: int = 3) -> DataFrame:
    """Worst k days per entity with their three most deviating metrics."""
    cells = F.array(*[F.struct(F.coalesce(F.abs(zcol(m)), F.lit(-1.0)).alias("size"), F.lit(m).alias("metric"), F.col(zcol(m)).alias("z")) for m in metrics])
    w = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), day)
    ranked = scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return ranked.withColumn("top_metrics", F.slice(F.sort_array(cells, asc=False), 1, top))


def level_outliers(df: DataFrame, value: str, by: Sequence[str], sigmas: float = 2.0) -> DataFrame:
    """Values above mean + 2 sd of the own series."""
    w = Window.partitionBy(*by)
    d = df.withColumn("mean", F.avg(value).over(w)).withColumn("sd", F.stddev_samp(value).over(w))
    return d.where(F.col(value) > F.col("mean") + sigmas * F.col("sd"))


def deviation_outliers(df: DataFrame, value: str, by: Sequence[str], sigmas: float = 2.0) -> DataFrame:
    """|value| beyond 2 sd (uncentred test) with the centred z beside it."""
    w = Window.partitionBy(*by)
    d = df.withColumn("mean", F.avg(value).over(w)).withColumn("sd", F.stddev_samp(value).over(w))
    return d.where((F.col("sd") > 0) & (F.abs(value) > sigmas * F.col("sd"))).withColumn("z", (F.col(value) - F.col("mean")) / F.col("sd"))


def known_event_check(df: DataFrame, events: DataFrame, value: str, by: Sequence[str], reach: int = 1, tolerance: float = 0.3) -> DataFrame:
    """Measured value on (or nearest to) a known day against the expected one."""
    from .joins import nearest_in_time

    near = nearest_in_time(events.select(*by, F.col("event_date").alias("day")), df.select(*by, "day", value), by, reach, value)
    j = events.withColumnRenamed("event_date", "day").join(near, [*by, "day"], "left")
    return j.withColumn("confirmed", F.coalesce(F.abs(F.col(value) - F.col("expected")) <= tolerance, F.lit(False)))
