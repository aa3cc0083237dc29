"""Hand-made frames for the semantic traps."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from nightloom.functions import ranks, scalar as S, tails
from nightloom.operators import composites, coupling, daily, effects, gaps, nights, quality, spc, windows as W
from nightloom.sources import sinks, tables

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def series(spark, values, entity="a", metric="m", days=None):
    rows = [(entity, metric, day(days[i] if days else i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity_id STRING, metric STRING, day DATE, value DOUBLE")


EM = ["entity_id", "metric"]


def test_ties_mid_ranks_and_delta(spark):
    a, b = [1, 2, 2, 3, 5, 5], [2, 2, 4, 5, 6]
    df = spark.createDataFrame([("g", True, float(v)) for v in a] + [("g", False, float(v)) for v in b], "g STRING, first BOOLEAN, v DOUBLE")
    r = ranks.mann_whitney(df, ["g"], "v", F.col("first")).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    delta = sum((x > y) - (x < y) for x in a for y in b) / len(a) / len(b)
    assert r.u1 == u and r.u2 == len(a) * len(b) - u
    assert r.delta == pytest.approx(delta)


def test_one_value_holds_most_rows(spark):
    df = spark.range(20000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    vals = sorted(r.v for r in df.collect())
    q = ranks.exact_quantiles(df, ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.977}).first()
    for name, p in (("lo", 0.1), ("mid", 0.5), ("hi", 0.977)):
        k = p * (len(vals) - 1)
        lo, hi = vals[math.floor(k)], vals[math.ceil(k)]
        assert q[name] == pytest.approx(lo + (hi - lo) * (k - math.floor(k)))


def test_bucket_is_monotone_over_signs(spark):
    vals = [-1e9, -3.5, -3.4999, -1e-12, 0.0, 1e-12, 2.0, 2.0001, 1e12]
    got = spark.createDataFrame([(v,) for v in vals], "v DOUBLE").select("v", ranks.magnitude_bucket("v").alias("b")).orderBy("v").collect()
    b = [r.b for r in got]
    assert b == sorted(b)


def test_gaps_rows_against_days(spark):
    s = series(spark, [1, 2, 3, 4], days=[0, 1, 5, 6])
    out = s.select("day", W.roll_mean("value", W.trailing(EM, 3)).alias("r"), W.roll_mean("value", W.trailing(EM, 3, mode="days")).alias("d")).orderBy("day").collect()
    assert [x.r for x in out] == [1, 1.5, 2, 3]
    assert [x.d for x in out] == [1, 1.5, 3, 3.5]


def test_interpolation_limit(spark):
    s = series(spark, [0, 8, 20], days=[0, 8, 10])
    out = {r.day: r.filled for r in gaps.interpolate(gaps.on_calendar(s, EM), "value", EM, limit=3).collect()}
    assert [out[day(i)] for i in range(11)] == [0, 1, 2, 3, None, 5, 6, 7, 8, 14, 20]


def test_carry_both_ways(spark):
    s = series(spark, [None, 2, None, 4, None])
    assert [r.filled for r in gaps.carry(s, "value", EM).orderBy("day").collect()] == [2, 2, 2, 4, 4]


def test_constant_series(spark):
    s = series(spark, [5.0] * 20)
    assert {r.z for r in s.select(W.z_score("value", EM).alias("z")).collect()} == {0.0}
    assert all(not r.alarm for r in spc.cusum(s, "value", EM).collect())
    wide = spark.createDataFrame([("a", day(i), 1.0, float(i)) for i in range(10)], "entity_id STRING, day DATE, x DOUBLE, y DOUBLE")
    assert coupling.pair_corr(wide.select("entity_id", "x", "y"), ["entity_id"]).first().r is None


@pytest.mark.parametrize("n", [1, 2, 4])
def test_short_series(spark, n):
    s = series(spark, list(range(n)))
    assert spc.rolling_shift(s, "value", EM).count() == 0
    stats = s.groupBy(*EM).agg(F.count("value").alias("n"), F.avg("value").alias("mean")).select(*quality.guarded("n", 5, "mean"))
    assert stats.first().status == "insufficient" and stats.first()["mean"] is None


def test_duplicate_days_keep_first_last_best(spark):
    rows = [("a", D0, "p1", "nap", 50.0, 1), ("a", D0, "p2", "long_sleep", 30.0, 2), ("a", D0, "p3", "long_sleep", 40.0, 3)]
    df = spark.createDataFrame(rows, "entity_id STRING, day DATE, pid STRING, type STRING, hrv DOUBLE, seq INT")
    key = ["entity_id", "day"]
    assert sinks.pick_per_key(df, key, ["seq"]).first().pid == "p3"
    assert sinks.pick_per_key(df, key, ["seq"], last=False).first().pid == "p1"
    assert sinks.pick_per_key(df, key, [F.col("type") == "long_sleep", "hrv", "pid"]).first().pid == "p3"


def test_three_day_keys(spark):
    raw = ["2024-03-01T23:30:00+02:00", "2024-03-01T23:30:00-05:00", "2024-03-01T23:30:00Z", "junk"]
    df = spark.createDataFrame([(r,) for r in raw], "raw STRING")
    got = df.select(*[S.day_key("raw", m, "Europe/Oslo").alias(m) for m in ("wall", "utc", "zone")]).collect()
    one, two = dt.date(2024, 3, 1), dt.date(2024, 3, 2)
    assert [tuple(r) for r in got[:3]] == [(one, one, one), (one, two, two), (one, one, two)]
    assert got[3].utc is None


def test_day_keys_do_not_depend_on_the_session_clock(spark):
    df = spark.createDataFrame([("2024-03-01T23:30:00-05:00",)], "raw STRING")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(S.day_key("raw", "utc")).first()[0] == dt.date(2024, 3, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def epochs(spark, **texts):
    rows = [(p, i, int(c)) for p, t in texts.items() for i, c in enumerate(t)]
    return spark.createDataFrame(rows, "period_id STRING, epoch_index INT, phase INT")


def brute_cycles(text):
    out, start, rem = [], None, False
    for i, c in enumerate(text):
        if c in "12":
            if rem:
                out.append((i - start) * 5)
                start, rem = i, False
            elif start is None:
                start = i
        elif c == "3":
            start, rem = (i if start is None else start), True
        elif rem:
            out.append((i - start) * 5)
            start, rem = None, False
    if rem:
        out.append((len(text) - start) * 5)
    return out


def test_phases(spark):
    texts = {"a": "4412233114233", "b": "2222444", "c": "4444", "d": "3314422333412213", "e": "1243124433"}
    ep = epochs(spark, **texts)
    got = {}
    for r in nights.sleep_cycles(ep, ["period_id"]).orderBy("period_id", "cycle").collect():
        got.setdefault(r.period_id, []).append(r.minutes)
    assert got == {k: c for k, t in texts.items() if (c := brute_cycles(t))}
    lat = {r.period_id: r.latency_min for r in nights.rem_latency(ep, ["period_id"]).collect()}
    assert lat["a"] == 15 and lat["b"] is None and "c" not in lat
    m = {(r.from_phase, r.to_phase): r for r in nights.transition_matrix(ep, ["period_id"]).collect()}
    assert len(m) == 16 and sum(r.n for r in m.values()) == sum(len(t) - 1 for t in texts.values())
    f = {r.period_id: r for r in nights.fragmentation(ep, ["period_id"]).collect()}
    assert f["a"].wakes == 2 and f["c"].per_sleep_hour is None


def test_step_is_found(spark):
    s = series(spark, [10 + (i % 3) for i in range(60)] + [20 + (i % 3) for i in range(60)])
    shift = spc.rolling_shift(s, "value", EM)
    best = shift.orderBy(F.abs("t").desc()).first()
    assert abs((best.day - day(60)).days) <= 1
    assert spc.cusum(s, "value", EM).where("alarm").agg(F.min("day")).first()[0] <= day(62)


def test_sentinels_and_nan(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 96.0), ("a", float("nan")), ("a", 30.0), ("a", None)], "entity_id STRING, spo2 DOUBLE")
    bad = quality.range_violations(df.where("spo2 > 0 or spo2 is null"), {"spo2": (70, 100, True)}, ["entity_id"])
    assert [r.problem for r in bad.collect()] == ["below 70"]
    text = sinks.json_safe(df).select(F.to_json(F.struct("spo2")).alias("j")).collect()
    assert text[2].j == "{}"
    assert df.select(S.clip("spo2", 0, 50)).collect()[4][0] is None


def test_composites_renormalise_or_fill(spark):
    df = spark.createDataFrame([(80.0, None), (None, None)], "a DOUBLE, b DOUBLE")
    w = {"a": 0.25, "b": 0.75}
    parts = {"a": F.col("a"), "b": F.col("b")}
    got = df.select(composites.weighted_available(parts, w).alias("x"), composites.weighted_neutral(parts, w).alias("y")).collect()
    assert (got[0].x, got[0].y) == (80.0, 57.5) and (got[1].x, got[1].y) == (None, 50.0)


def test_labels(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(S.p_text(F.lit(0.0004))) == "p<0.001" and val(S.p_text(F.lit(float("nan")))) == "N/A" and val(S.p_text(F.lit(0.0456))) == "p=0.046"
    assert val(S.level_status(F.lit(" elevated "))) == "warning" and val(S.level_label(F.lit("  "))) == "N/A"
    assert val(S.kpi_status(F.lit(9.0), 15, 10)) == "critical" and val(S.kpi_status(F.lit(9.0), 8, 10)) == "warning"
    assert val(S.strain_ratio(F.lit(4.0), F.lit(0.0))) == 5.0 and val(S.strain_ratio(F.lit(0.0), F.lit(0.0))) == 1.0
    assert val(S.change_direction(F.lit(-5.0), F.lit(-10.0), False)) == "improving"
    assert val(S.change_direction(F.lit(5.0), F.lit(10.0), None)) == "declining"
    assert val(S.norm_cdf(F.lit(1.959963984540054))) == pytest.approx(0.975, abs=1e-6)


def test_tails_known_values():
    assert tails.t_p2_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    import duckdb
    assert duckdb.execute("SELECT " + tails.t_p2_sql("2.0e0", "10")).fetchone()[0] == pytest.approx(0.07338803, abs=1e-7)
    for n, point in ((6, 2.446912), (10, 2.228139), (30, 2.042272), (2000, 1.961151)):
        assert duckdb.execute("SELECT " + tails.t975_sql(str(n))).fetchone()[0] == pytest.approx(point, abs=2e-4)
    assert tails.gamma_sf(1.5, 3.0) == pytest.approx(0.11161023, abs=1e-7)
    assert tails.beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert tails.mwu_exact_p(0, 3, 3) == pytest.approx(0.1)


def test_tail_columns(spark):
    df = spark.createDataFrame([(2.0, 10.0), (None, 3.0)], "t DOUBLE, df DOUBLE")
    got = effects.with_t_p(df).collect()
    assert got[0].p == pytest.approx(0.07338803, abs=1e-7) and got[1].p is None
    x = df.select(tails.f_sf(F.lit(4.0), F.lit(2.0), F.lit(10.0)).alias("f"), tails.exact_u_p(F.lit(0.0), F.lit(3.0), F.lit(3.0)).alias("u")).first()
    assert x.f == pytest.approx(0.05292, abs=1e-4) and x.u == pytest.approx(0.1)


def test_declared_layout_fills_missing_columns(spark):
    out = tables.declared(spark.range(1), "id BIGINT, spo2 DOUBLE")
    assert out.dtypes == [("id", "bigint"), ("spo2", "double")] and out.first().spo2 is None


def test_alert_machine(spark):
    pre = [0.35, 0.4, 0.32, 0.4, 0.1, 0.4, 0.4, 0.6, 0.4, 0.4, 0.4]
    df = spark.createDataFrame([("a", day(i), p, 0.0) for i, p in enumerate(pre)], "entity_id STRING, day DATE, p_pre DOUBLE, p_active DOUBLE")
    got = [(r.day, r.level) for r in spc.alert_machine(df, ["entity_id"]).orderBy("day").collect()]
    assert got == [(day(2), "YELLOW"), (day(7), "RED"), (day(10), "YELLOW")]


def test_daily_pivot_and_overlap(spark):
    s = series(spark, [1, 2]).unionByName(series(spark, [3], metric="k")).unionByName(series(spark, [4], entity="b"))
    w = daily.widen(s, ["k", "m"]).orderBy("entity_id", "day").collect()
    assert (w[0].k, w[0].m, w[1].k) == (3, 1, None)
    assert [r.day for r in daily.overlap_days(s).collect()] == [D0]
