"""Operators against plain NumPy on small inputs, and invariance under partitioning."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.operators import anomaly, changepoint, complexity, density, forest, gaps, impact, resample, spc, spectral, trend

D0 = dt.date(2024, 1, 1)


def frame(spark, x, entity="a"):
    return spark.createDataFrame([(entity, D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)], "entity_id STRING, day DATE, value DOUBLE")


RNG = np.random.default_rng(7)
X = np.round(RNG.normal(0, 1, 300).cumsum() * 0.3 + RNG.normal(0, 1, 300), 3)


def test_cusum_equals_recursion(spark):
    mu, sd = X[:14].mean(), X[:14].std()
    pos = [0.0]
    for v in X[1:]:
        pos.append(max(0.0, pos[-1] + v - mu - 0.5 * sd))
    got = [r.cusum_pos for r in spc.cusum(frame(spark, X), "value", ["entity_id"]).orderBy("day").collect()]
    assert np.allclose(got, pos, atol=1e-9)


def test_ewma_equals_recursion(spark):
    e = [X[0]]
    for v in X[1:]:
        e.append(0.2 * v + 0.8 * e[-1])
    got = [r.ewma for r in spc.ewma(frame(spark, X), "value", ["entity_id"]).orderBy("day").collect()]
    assert np.allclose(got, e, atol=1e-10)


def test_matrix_profile(spark):
    m, zone = 5, 2
    win = np.lib.stride_tricks.sliding_window_view(X, m)
    z = (win - win.mean(1, keepdims=True)) / win.std(1, keepdims=True)
    want = [min(np.sqrt(((z[i] - z[j]) ** 2).sum()) for j in range(len(z)) if abs(i - j) > zone) for i in range(len(z))]
    got = [r.distance for r in anomaly.matrix_profile(frame(spark, X), "value", ["entity_id"], m).orderBy("pos").collect()]
    assert np.allclose(got, want, atol=1e-6)


def test_blocks_cover_long_series(spark):
    y = np.round(RNG.normal(0, 1, 700), 2)
    got = complexity.sample_entropy(frame(spark, y), "value", ["entity_id"]).first()
    r, n = 0.2 * y.std(), len(y) - 2
    near = lambda i, j, m: np.abs(y[i:i + m] - y[j:j + m]).max() <= r
    b = sum(near(i, j, 2) for i in range(n) for j in range(n) if i != j)
    a = sum(near(i, j, 3) for i in range(n) for j in range(n) if i != j)
    assert (got.a, got.b) == (a, b)
    assert got.sampen == pytest.approx(-math.log(a / b))


def test_lomb_scargle(spark):
    t = np.sort(RNG.uniform(0, 5e4, 60))
    y = np.sin(2 * np.pi * 0.0021 * t) + RNG.normal(0, 0.2, 60)
    freqs = spectral.linspace(0.001, 0.005, 30)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y)], "entity_id STRING, s DOUBLE, value DOUBLE")
    got = [r.power for r in spectral.lomb_scargle(df, "value", F.col("s"), ["entity_id"], freqs).orderBy("k").collect()]
    yc, tt = y - y.mean(), t - t.min()
    want = []
    for f in freqs:
        w = 2 * np.pi * f
        tau = np.arctan2(np.sin(2 * w * tt).sum(), np.cos(2 * w * tt).sum()) / (2 * w)
        c, s = np.cos(w * (tt - tau)), np.sin(w * (tt - tau))
        want.append(((yc @ c) ** 2 / (c @ c) + (yc @ s) ** 2 / (s @ s)) / (yc @ yc))
    assert np.allclose(got, want, atol=1e-9)
    assert abs(freqs[int(np.argmax(got))] - 0.0021) < 2e-4


def test_dbscan(spark):
    pts = np.concatenate([RNG.normal(0, 0.2, (20, 2)), RNG.normal(5, 0.2, (15, 2)), [[10, -10]]])
    df = spark.createDataFrame([("a", D0 + dt.timedelta(days=i), float(p[0]), float(p[1])) for i, p in enumerate(pts)], "entity_id STRING, day DATE, x DOUBLE, y DOUBLE")
    got = [r.cluster for r in density.dbscan(df, ["x", "y"], eps=1.0).orderBy("day").collect()]
    assert set(got[:20]) == {0} and set(got[20:35]) == {1} and got[35] == -1


def test_isolation_forest_ranks_planted_outlier_first(spark):
    pts = RNG.normal(0, 1, (80, 3))
    pts[41] = [9, -9, 9]
    df = spark.createDataFrame([("a", D0 + dt.timedelta(days=i), *map(float, p)) for i, p in enumerate(pts)], "entity_id STRING, day DATE, x DOUBLE, y DOUBLE, z DOUBLE")
    out = forest.isolation_forest(df, ["x", "y", "z"], trees=60)
    rows = out.orderBy(F.desc("forest_score")).collect()
    assert rows[0].day == D0 + dt.timedelta(days=41)
    assert sum(r.forest_anomaly for r in rows) == 8
    again = forest.isolation_forest(df.repartition(5), ["x", "y", "z"], trees=60).orderBy(F.desc("forest_score")).collect()
    assert [r.day for r in again[:5]] == [r.day for r in rows[:5]]


def test_run_lengths_pruned_equals_full():
    x = np.concatenate([RNG.normal(0, 1, 60), RNG.normal(4, 1, 60)])
    x = (x - x.mean()) / x.std()
    a = changepoint.run_length_probabilities(x, 1 / 30, recent=4)
    b = changepoint.run_length_probabilities(x, 1 / 30, recent=4, prune=0.0)
    assert np.allclose(a, b, atol=1e-9)
    assert 60 <= int(np.argmax(a[10:])) + 10 <= 66


def test_segmentation_equals_dynamic_program():
    x = np.concatenate([RNG.normal(0, 1, 30), RNG.normal(3, 1, 25), RNG.normal(1, 1, 20)])
    pen, k, n = 6.0, 5, len(x)
    cost = lambda a, b: ((x[a:b] - x[a:b].mean()) ** 2).sum()
    best, last = [-pen] + [math.inf] * n, [0] * (n + 1)
    for b in range(k, n + 1):
        best[b], last[b] = min((best[a] + cost(a, b) + pen, a) for a in range(0, b - k + 1))
    want, b = [], n
    while last[b] > 0:
        want.append(last[b])
        b = last[b]
    assert changepoint.optimal_segments(x, pen, k) == sorted(want)


def test_impact_recovers_a_planted_step(spark):
    n = 200
    y = [5 + 0.01 * i + (2 if (i % 7) == 5 else 0) + (3.0 if i >= 150 else 0) + 0.05 * math.sin(i * 1.7) for i in range(n)]
    df = frame(spark, y).withColumn("metric", F.lit("m"))
    r = impact.impact(df, ["entity_id", "metric"], F.lit(D0 + dt.timedelta(days=150))).first()
    assert r.effect == pytest.approx(3.0, abs=0.05) and r.p < 0.001 and r.ci_lo < 3.0 < r.ci_hi
    pre = impact.placebo(df, ["entity_id", "metric"], F.lit(D0 + dt.timedelta(days=150)))
    assert impact.placebo_verdict(pre, ["entity_id"]).first().verdict in ("PASS", "PARTIAL")


def test_recovery_curve_and_crossing(spark):
    df = frame(spark, [30 * (1 - math.exp(-i / 17.7828)) + 10 for i in range(90)]).withColumn("t", F.datediff("day", F.lit(D0)))
    fit = trend.exp_recovery(df, "value", "t", ["entity_id"])
    r = fit.first()
    assert r.tau == pytest.approx(17.7828) and r.gain == pytest.approx(30) and r.r2 > 0.999999
    ols = trend.ols(df, "value", "t", ["entity_id"])
    both = ols.join(fit.select("entity_id", "tau", "gain", "base"), "entity_id")
    x = trend.crossing(both, 35.0, "above", D0).first()
    assert x.exp_days == math.floor(-17.7828 * math.log(1 - 25 / 30))


def test_bootstrap_spread_is_right(spark):
    y = RNG.normal(0, 2, 400)
    r = resample.block_bootstrap(frame(spark, y), ["entity_id"], block=1, reps=600).first()
    assert r.boot_sd == pytest.approx(y.std() / 20, rel=0.12)
    m = resample.bootstrap_stat(frame(spark, y), ["entity_id"], lambda c: F.median(c), reps=50).first()
    assert m.ci_lo < np.median(y) < m.ci_hi
    p = spark.range(400).select(F.lit("a").alias("entity_id"), "id", (F.col("id") % 10).cast("double").alias("value"))
    q = resample.poisson_bootstrap_mean(p, ["entity_id"], "id", reps=300).first()
    assert q.boot_sd == pytest.approx(np.std(np.arange(400) % 10) / 20, rel=0.15)


def test_sessions_equal_row_by_row(spark):
    us = np.sort(RNG.integers(0, 40 * 3600, 300))
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s))) for s in us], "entity_id STRING, ts TIMESTAMP_NTZ")
    want, run = [], [us[0]]
    for a, b in zip(us, us[1:]):
        if b - a > 600:
            want.append(run)
            run = []
        run.append(b)
    want.append(run)
    got = gaps.gap_sessions(df, ["entity_id"], gap_s=600).orderBy("start_us").collect()
    assert [(r.n, (r.end_us - r.start_us) // 1_000_000) for r in got] == [(len(w), w[-1] - w[0]) for w in want if len(w) >= 2]


def test_partitioning_changes_nothing(spark):
    base = frame(spark, X).unionByName(frame(spark, X[::-1], "b")).withColumn("metric", F.lit("m"))
    em = ["entity_id", "metric"]
    jobs = [
        lambda d: spc.cusum(d, "value", em).select("entity_id", "day", F.round("cusum_pos", 9)),
        lambda d: complexity.fluctuation(d, "value", em, range(4, 12)).select("entity_id", F.round("alpha", 9)),
        lambda d: changepoint.segmentation(d).select("entity_id", "day"),
        lambda d: complexity.recurrence(d, "value", em).select("entity_id", "recurrences", F.round("determinism", 9)),
        lambda d: resample.bootstrap_mean_diff(d, em, F.col("day") < F.lit(D0 + dt.timedelta(days=100)), reps=20).select("entity_id", F.round("ci_lo", 9)),
    ]
    for job in jobs:
        want = sorted(map(tuple, job(base).collect()))
        assert sorted(map(tuple, job(base.orderBy(F.rand(3)).repartition(7)).collect())) == want


def test_lomb_scargle_deals_samples_not_frequencies(spark, monkeypatch):
    """Long series in blocks, short and constant ones, null keys, values and times give the direct sums; frequencies are no rows before the sums."""
    monkeypatch.setattr(spectral, "BLOCK", 32)
    monkeypatch.setattr(spectral, "CHUNK", 7)
    freqs = spectral.linspace(0.001, 0.005, 5)
    rows = [("long", float(t), float(v)) for t, v in zip(RNG.uniform(0, 5e4, 150), RNG.normal(3, 1, 150))]
    rows += [(None, float(t), float(v)) for t, v in zip(RNG.uniform(0, 5e4, 25), RNG.normal(3, 1, 25))]
    rows += [("flat", float(t), 0.1) for t in range(70)] + [("few", float(t), float(t)) for t in range(19)]
    rows += [("long", None, 9.0), ("long", 5.0, None), (None, None, 9.0)] + [("untimed", None, float(t)) for t in range(20)]
    df = spark.createDataFrame(rows, "entity_id STRING, s DOUBLE, value DOUBLE").repartition(4)
    spectrum = spectral.lomb_scargle(df, "value", F.col("s"), ["entity_id"], freqs)
    assert "Generate" not in spectrum._jdf.queryExecution().toString()
    got = {(r.entity_id, r.k): r.power for r in spectrum.collect()}
    assert {e for e, _ in got} == {"long", None, "flat", "untimed"} and len(got) == 20
    assert all(got[e, k] is None for e in ("flat", "untimed") for k in range(5))
    for e in ("long", None):
        every = np.array([v for x, _, v in rows if x == e and v is not None])
        t, y = np.array([(t, v) for x, t, v in rows if x == e and None not in (t, v)]).T
        y = y - every.mean()
        for k, f in enumerate(freqs):
            w = 2 * np.pi * f * t
            th = np.arctan2(2 * (np.cos(w) * np.sin(w)).sum(), (np.cos(w) ** 2 - np.sin(w) ** 2).sum()) / 2
            c, s = np.cos(w - th), np.sin(w - th)
            want = ((y @ c) ** 2 / (c @ c) + (y @ s) ** 2 / (s @ s)) / (len(every) * every.var())
            assert got[e, k] == pytest.approx(want, abs=1e-9)


def test_night_grid_bridges_without_dealing_the_grid(spark):
    """Holes are filled after the ordering of what was measured: no join, nulls at the ends stay."""
    from nightloom.operators import nights

    rows = [("a", 2, None), ("a", 4, 1.0), ("a", 4, 3.0), ("a", 6, None), ("a", 8, 4.0), ("a", 9, None), ("b", 0, 5.0), ("b", 130, 1.0)]
    df = spark.createDataFrame(rows, "p STRING, b INT, value DOUBLE")
    out = nights.night_grid(df, ["p"], "value", F.col("b") * 5.0 + 1)
    assert "Join" not in out._jdf.queryExecution().toString()
    got = {(r.p, r.bin): r.value for r in out.collect()}
    assert got == {("a", 2): None, ("a", 3): None, ("a", 4): 2.0, ("a", 5): 2.5, ("a", 6): 3.0, ("a", 7): 3.5, ("a", 8): 4.0, ("a", 9): None, ("b", 0): 5.0}


def test_interval_join_repeats_periods_of_crowded_hours_only(spark, monkeypatch):
    """Every sample meets its periods, overlapping and crowded ones too, and quiet hours list a period once."""
    from nightloom.operators import joins

    monkeypatch.setattr(joins, "CROWD", 20)
    hour = joins.HOUR_US
    samples = [("a", i * 1_000_000, i) for i in range(100)] + [("a", 5 * hour, 100), ("b", 10, 101), (None, 10, 102)]
    periods = [("a", 1, 0, 5 * hour), ("a", 2, 50_000_000, 60_000_000), ("b", 3, 11, 20), (None, 4, 0, 20)]
    left = spark.createDataFrame(samples, "entity_id STRING, at_us LONG, i INT")
    right = spark.createDataFrame(periods, "entity_id STRING, p INT, start_us LONG, end_us LONG")
    got = sorted((r.i, r.p) for r in joins.interval_join(left, right).collect())
    assert got == sorted((i, p) for e, at, i in samples for o, p, lo, hi in periods if e is not None and e == o and lo <= at <= hi)
    listed = joins.listed_hours(right, joins.crowded_hours(left, "entity_id", "at_us", hour, 8), "entity_id", "start_us", "end_us", hour)
    assert listed.filter("p = 1").count() == 5 + 8 and listed.filter("p = 3").count() == 1
