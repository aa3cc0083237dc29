"""Composite, weekly and sleep-summary plans."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import composites as C, complexity as X, coupling as CO, effects as E, trend as T, windows as W
from ..sources import adapters as A
from .registry import R, register
from .stats import rounded

sql, r6 = A.sql, S.r6
CUT, AS_OF = date(1998, 6, 1), date(2001, 6, 1)


def _clip(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, 0), 100) END"


def _avail(parts: dict[str, str], weights: dict[str, float]) -> str:
    top = " + ".join(f"coalesce(({p})*{weights[k]}e0, 0)" for k, p in parts.items())
    low = " + ".join(f"CASE WHEN ({p}) IS NOT NULL THEN {weights[k]}e0 ELSE 0 END" for k, p in parts.items())
    return f"({top})/nullif({low}, 0)"


def _cdf(c: str, m: float, s: float) -> str:
    return "(" + S.erfc_sql(f"(-(({c}-{m}e0)/{s}e0)/{2 ** 0.5!r}e0)") + "*0.5e0*100)"


DYS = _avail({
    "rmssd": f"100 - {_cdf('rmssd', 42.0, 15.0)}", "dfa": _clip("abs(dfa_alpha1-1.0e0)/0.5e0*100"), "dip": _clip("100 - hr_dip_pct/15.0e0*100"),
    "hr_recovery": _clip(_cdf("awake_hr", 75.0, 10.0)), "cv_age": _clip("cv_age_delta/15.0e0*100"), "spo2": _clip("(97.5e0-spo2)/3.0e0*100"),
}, C.DYSFUNCTION_WEIGHTS)
CARDIO = _avail({
    "hr": _clip("(sleep_hr-60)/40*100"), "hrv": f"100 - {_cdf('rmssd', 42.0, 15.0)}", "dip": _clip("100 - hr_dip_pct/15.0e0*100"),
    "spo2": _clip("(97.5e0-spo2)/3.0e0*100"), "cv_age": _clip("cv_age_delta/15.0e0*100"),
}, C.CARDIO_WEIGHTS)


@register("weighted_available", sql("bd", "SELECT entity_id, day, " + R(DYS, "dysfunction") + ", " + R(CARDIO, "cardio_risk") + " FROM bd"))
def _(spark, d):
    b = A.bio_daily(spark, d)
    return b.select("entity_id", "day", r6(C.dysfunction_index(b)).alias("dysfunction"), r6(C.cardio_risk()).alias("cardio_risk"))


def _slope(c: str) -> str:
    return f"CASE WHEN count(*) OVER w = 7 AND count({c}) OVER w >= 3 THEN regr_slope({c}, rn) OVER w END"


@register("activity_score", sql("bd", "r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day) AS rn FROM bd), p AS (SELECT entity_id, day, "
    + ", ".join(["CASE WHEN count(temp_deviation) OVER w >= 3 THEN avg(temp_deviation) OVER w END*100 AS a", _slope("spo2") + " AS b", _slope("rmssd") + " AS c", _slope("awake_pct") + " AS e",
                 "CASE WHEN count(strain_ratio) OVER w >= 3 THEN avg(strain_ratio) OVER w END AS f"])
    + " FROM r WINDOW w AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT entity_id, day, " + R(_avail(
        {"temp": _clip("a"), "spo2": _clip("-b/0.5e0*100"), "hrv": _clip("-c*100"), "frag": _clip("e/2.0e0*100"), "recovery": _clip("(f-1)/2.0e0*100")}, C.ACTIVITY_WEIGHTS), "activity") + " FROM p"))
def _(spark, d):
    b = A.bio_daily(spark, d).withColumn("rn", F.row_number().over(W.series(["entity_id"])))
    return b.select("entity_id", "day", r6(C.activity_score()).alias("activity"))


@register("recovery_index", sql("bd", (lambda m: "SELECT entity_id, day, " + R(_avail({
    "r": _clip(f"rmssd/(30.0e0+({m!r}e0-24)/12*5)*100"), "h": _clip(f"(72.0e0+({m!r}e0-24)/12*(-2))/sleep_hr*100"), "e": _clip("efficiency/85.0e0*100")},
    {"r": 1.0, "h": 1.0, "e": 1.0}), "recovery") + " FROM bd")(S.months_between_event(AS_OF, CUT))))
def _(spark, d):
    return A.bio_daily(spark, d).select("entity_id", "day", r6(C.recovery_index(CUT, AS_OF)).alias("recovery"))


_HITS = {"sleep_hr": "sleep_hr > 80", "rmssd": "rmssd < 15", "efficiency": "efficiency < 85", "temp": "abs(temp_deviation) > 0.5", "spo2": "spo2 < 95", "deep": "deep_pct < 10", "rem": "rem_pct < 15"}
_LOAD = "CAST(" + " + ".join(f"coalesce(({h})::INT, 0)" for h in _HITS.values()) + " AS INTEGER)"


@register("allostatic_count", sql("bd", f"SELECT entity_id, day, {_LOAD} AS load FROM bd"))
def _(spark, d):
    return A.bio_daily(spark, d).select("entity_id", "day", C.exceedance_count().alias("load"))


@register("allostatic_means", sql("bd", f"m AS (SELECT entity_id, avg(sleep_hr) AS sleep_hr, avg(rmssd) AS rmssd, avg(efficiency) AS efficiency, avg(abs(temp_deviation)) AS temp_deviation, avg(spo2) AS spo2, avg(deep_pct) AS deep_pct, avg(rem_pct) AS rem_pct FROM bd GROUP BY 1) SELECT entity_id, {_LOAD} AS load FROM m"))
def _(spark, d):
    return C.exceedance_of_means(A.bio_daily(spark, d), ["entity_id"]).select("entity_id", "load")


@register("baseline_response", sql("bd", "z AS (SELECT entity_id, day, " + ", ".join(
    f"abs({m} - avg({m}) FILTER (WHERE day < DATE '1998-06-01') OVER w)/(stddev_samp({m}) FILTER (WHERE day < DATE '1998-06-01') OVER w) AS {m}" for m in ("rmssd", "sleep_hr", "efficiency", "temp_deviation", "spo2"))
    + " FROM bd WINDOW w AS (PARTITION BY entity_id)) SELECT entity_id, day, " + R("(rmssd+sleep_hr+efficiency+temp_deviation+coalesce(spo2,0))/(4 + (spo2 IS NOT NULL)::INT)", "response") + " FROM z"))
def _(spark, d):
    c = C.response_to_baseline(["rmssd", "sleep_hr", "efficiency", "temp_deviation", "spo2"], F.col("day") < F.lit(CUT))
    return A.bio_daily(spark, d).select("entity_id", "day", r6(c).alias("response"))


@register("biomarker_frame")
def _(spark, d):
    return C.biomarker_frame(A.bio_daily(spark, d), CUT, AS_OF, CUT)


STREAMS = {"temperature": ("abs(temp_deviation)", 1), "spo2": ("spo2", -1), "hrv": ("rmssd", -1), "sleep_frag": ("awake_pct", 1), "resting_hr": ("sleep_hr", 1), "activity": ("steps", -1)}
_SC = "b AS (SELECT *, day <= min(day) OVER (PARTITION BY entity_id) + 14 AS base FROM bd), z AS (SELECT entity_id, day, " + ", ".join(
    f"({c} - avg({c}) FILTER (WHERE base) OVER w)/(CASE WHEN coalesce(stddev_samp({c}) FILTER (WHERE base) OVER w, 0) = 0 THEN 1 ELSE stddev_samp({c}) FILTER (WHERE base) OVER w END)*{s} AS {k}"
    for k, (c, s) in STREAMS.items()) + " FROM b WINDOW w AS (PARTITION BY entity_id)), c AS (SELECT entity_id, day, " + " + ".join(
    f"coalesce({_clip(f'{k}*25+50')}, 50)*{C.STREAM_WEIGHTS[k]}e0" for k in STREAMS) + " AS composite FROM z)"


def stream_composite(spark, d):
    return C.stream_composite(A.bio_daily(spark, d), {k: (F.expr(c), s) for k, (c, s) in STREAMS.items()})


@register("weighted_neutral", sql("bd", _SC + " SELECT entity_id, day, " + R("composite", "composite") + ", " + R("CASE WHEN count(*) OVER w >= 3 THEN avg(composite) OVER w END", "composite_7d")
    + " FROM c WINDOW w AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"))
def _(spark, d):
    return stream_composite(spark, d).select("entity_id", "day", r6("composite").alias("composite"), r6("composite_7d").alias("composite_7d"))


_PW = lambda x, k: f"CASE WHEN {x} <= {k[0][0]} THEN {k[0][1]}.0e0 " + " ".join(
    f"WHEN {x} <= {b[0]} THEN {a[1]}.0e0 + ({x} - ({a[0]}))/({b[0]} - ({a[0]}))*({b[1]} - {a[1]})" for a, b in zip(k, k[1:])) + f" ELSE {k[-1][1]}.0e0 END"
_RISK = ("g AS (SELECT entity_id, regr_slope(spo2, date_diff('day', DATE '1995-01-01', day)) AS slope, stddev_samp(spo2)/avg(spo2)*100 AS cv_pct, avg(CASE WHEN spo2 < 95 THEN 1.0e0 ELSE 0.0e0 END) FILTER (WHERE spo2 IS NOT NULL)*100 AS desat_pct, avg(awake_pct) AS mean_bdi, corr(spo2, sleep_hr) AS r, avg(spo2) AS spo2_mean, avg(strain_ratio)*20 AS systemic FROM bd GROUP BY 1), "
    "k AS (SELECT *, 0.30e0*(CASE WHEN slope >= 0 THEN 0.0e0 WHEN slope >= -0.02 THEN least(abs(slope/-0.02e0)*50, 100) ELSE least(50+abs(slope/-0.02e0)*25, 100) END) + 0.20e0*("
    + _PW("cv_pct", [(0.5, 0), (1.0, 50), (2.0, 100)]) + ") + 0.20e0*(" + _PW("desat_pct", [(0, 0), (5, 40), (15, 70), (35, 100)]) + ") + 0.15e0*(" + _PW("mean_bdi", [(0, 0), (5, 30), (15, 70), (30, 100)])
    + ") + 0.15e0*(" + _PW("r", [(-0.3, 0), (0.0, 50), (0.5, 100)]) + ") AS risk FROM g)")


@register("airway_risk", sql("bd", _RISK + " SELECT entity_id, " + R("risk", "airway_risk") + ", CASE WHEN risk < 20 THEN 'LOW' WHEN risk < 40 THEN 'MODERATE' WHEN risk < 60 THEN 'ELEVATED' ELSE 'HIGH' END AS level, "
    + R("systemic*0.7e0 + risk*0.3e0*(CASE WHEN spo2_mean < 95 THEN 1.5e0 WHEN spo2_mean < 96 THEN 1.2e0 ELSE 1.0e0 END)", "combined") + " FROM k"))
def _(spark, d):
    x = F.datediff("day", F.lit(date(1995, 1, 1)))
    g = A.bio_daily(spark, d).groupBy("entity_id").agg(
        F.regr_slope(F.col("spo2"), x).alias("slope"), (F.stddev_samp("spo2") / F.avg("spo2") * 100).alias("cv_pct"), (F.avg((F.col("spo2") < 95).cast("double")) * 100).alias("desat_pct"),
        F.avg("awake_pct").alias("mean_bdi"), W.pearson("spo2", "sleep_hr").alias("r"), F.avg("spo2").alias("spo2_mean"), (F.avg("strain_ratio") * 20).alias("systemic"))
    out = C.combined_risk(C.airway_risk(g))
    return out.select("entity_id", r6("airway_risk").alias("airway_risk"), "level", r6("combined").alias("combined"))


@register("feature_importance")
def _(spark, d):
    """Importance of each metric for the post-event flag."""
    by = ["entity_id", "metric"]
    comp = stream_composite(spark, d).select("entity_id", "day", "composite")
    sig = A.line_signals(spark, d)
    post = F.col("day") >= F.lit(CUT)
    mi = X.mutual_information(sig, "value", post, by)
    r = sig.join(comp, ["entity_id", "day"]).groupBy(*by).agg(W.pearson("value", post.cast("double")).alias("r_flag"), W.pearson("value", "composite").alias("r_composite"))
    dd = E.effect_sizes(E.two_sample(sig, by, ~post)).select(*by, "d")
    return C.feature_importance(r.join(mi, by).join(dd, by))


# --- weekly ------------------------------------------------------------------

WEEK = """w AS (SELECT entity_id, metric, avg(value) FILTER (WHERE day >= DATE '2001-05-26') AS t, avg(value) FILTER (WHERE day < DATE '2001-05-26') AS l,
    count(*) FILTER (WHERE day >= DATE '2001-05-26') AS n_this, count(*) FILTER (WHERE day < DATE '2001-05-26') AS n_last FROM ls WHERE day BETWEEN DATE '2001-05-19' AND DATE '2001-06-01' GROUP BY ALL),
    wk AS (SELECT *, t - l AS delta, (t-l)/abs(l)*100 AS pct FROM w)"""
DEFS = [("disc", False, 4.0, 6.0, None, 7.0), ("price", True, 30.0, 45.0, 20.0, None), ("qty", True, 22.0, 28.0, 15.0, None), ("tax", None, 3.0, 5.0, None, None)]


@register("weekly_compare", sql("ls", WEEK + " SELECT entity_id, metric, n_this, n_last, " + ", ".join([R("t", "this_mean"), R("l", "last_mean"), R("delta", "delta"), R("pct", "pct")]) + " FROM wk"))
def _(spark, d):
    return rounded(C.weekly_compare(A.line_signals(spark, d), AS_OF), ["entity_id", "metric", "n_this", "n_last"], "this_mean", "last_mean", "delta", "pct")


def defs(spark):
    return spark.createDataFrame(DEFS, "metric STRING, higher_is_better BOOLEAN, normal_low DOUBLE, normal_high DOUBLE, critical_low DOUBLE, critical_high DOUBLE")


_V = ", ".join("('{}', {}, {}, {}, {}, {})".format(m, *["NULL" if v is None else str(v).upper() if isinstance(v, bool) else v for v in r]) for m, *r in DEFS)
STATUS = WEEK + f""", df(metric, better, lo, hi, cl, ch) AS (VALUES {_V}),
    dr AS (SELECT *, CASE WHEN abs(pct) < 3 THEN 'stable' WHEN (coalesce(better, false) AND delta > 0) OR (NOT coalesce(better, false) AND delta <= 0) THEN 'improving' ELSE 'declining' END AS direction FROM wk JOIN df USING (metric)),
    st AS (SELECT *, CASE WHEN t < cl OR t > ch THEN 'critical' WHEN direction = 'declining' AND abs(pct) > 10 THEN 'critical' WHEN direction = 'declining' AND abs(pct) > 5 THEN 'warning'
      WHEN t BETWEEN lo AND hi THEN 'good' ELSE 'warning' END AS status FROM dr)"""


@register("traffic_light", sql("ls", STATUS + " SELECT entity_id, metric, direction, status FROM st"))
def _(spark, d):
    return C.weekly_status(C.weekly_compare(A.line_signals(spark, d), AS_OF), defs(spark)).select("entity_id", "metric", "direction", "status")


@register("summary_lines", sql("ls", STATUS + """, k AS (SELECT *, CASE WHEN status = 'critical' THEN 1 WHEN direction = 'improving' THEN 2 WHEN direction = 'declining' THEN 3 END AS kind FROM st),
    n AS (SELECT *, row_number() OVER (PARTITION BY entity_id, kind ORDER BY abs(pct) DESC, metric) AS k FROM k WHERE kind IS NOT NULL),
    m AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY kind, k) AS line_no FROM n WHERE k <= CASE WHEN kind = 3 THEN 1 ELSE 2 END)
    SELECT entity_id, CAST(line_no AS INTEGER) AS line_no, CASE kind WHEN 1 THEN printf('[!] %s: weekly mean %.1f, %+.1f%% on the week before (%s)', metric, t, pct, direction) WHEN 2 THEN printf('[+] %s: weekly mean %.1f, better by %+.1f%%', metric, t, pct)
      ELSE printf('[-] %s: weekly mean %.1f, worse by %+.1f%%', metric, t, pct) END AS line FROM m WHERE line_no <= 5"""))
def _(spark, d):
    return C.summary_lines(C.weekly_status(C.weekly_compare(A.line_signals(spark, d), AS_OF), defs(spark)))


@register("baseline_vs_week", sql("ls", """SELECT entity_id, metric, count(*) FILTER (WHERE day >= DATE '1998-05-18' AND day < DATE '1998-06-01') AS n_baseline, count(*) FILTER (WHERE day BETWEEN DATE '2001-05-26' AND DATE '2001-06-01') AS n_current, """
    + R("(avg(value) FILTER (WHERE day BETWEEN DATE '2001-05-26' AND DATE '2001-06-01') - avg(value) FILTER (WHERE day >= DATE '1998-05-18' AND day < DATE '1998-06-01'))/abs(avg(value) FILTER (WHERE day >= DATE '1998-05-18' AND day < DATE '1998-06-01'))*100", "pct") + " FROM ls GROUP BY entity_id, metric"))
def _(spark, d):
    return rounded(C.event_baseline_compare(A.line_signals(spark, d), CUT, AS_OF), ["entity_id", "metric", "n_baseline", "n_current"], "pct")


# --- sleep -------------------------------------------------------------------

@register("sleep_timing", sql("ev", """s AS (SELECT entity_id, day, min(hour(ts)+minute(ts)/60.0e0) AS bed, max(hour(ts)+minute(ts)/60.0e0) AS wake FROM ev GROUP BY ALL), m AS (SELECT *, (bed+wake)/2 AS mid, isodow(day) IN (5,6) AS w,
    row_number() OVER (PARTITION BY entity_id ORDER BY day) <= count(*) OVER (PARTITION BY entity_id)//2 AS h FROM s)
    SELECT entity_id, count(*) AS n, """ + ", ".join([R("avg(mid) FILTER (WHERE NOT w)", "weekday"), R("avg(mid) FILTER (WHERE w)", "weekend"), R("abs(avg(mid) FILTER (WHERE w) - avg(mid) FILTER (WHERE NOT w))", "social_jet_lag"),
    R("stddev_samp(mid)/avg(mid)*100", "cv_pct"), R("avg(mid) FILTER (WHERE h)", "first_half"), R("avg(mid) FILTER (WHERE NOT h)", "second_half")]) + " FROM m GROUP BY 1"))
def _(spark, d):
    h = S.clock_hour("ts")
    n = A.samples(spark, d).groupBy("entity_id", "day").agg(((F.min(h) + F.max(h)) / 2).alias("midpoint"))
    return rounded(C.sleep_timing(n), ["entity_id", "n"], "weekday", "weekend", "social_jet_lag", "cv_pct", "first_half", "second_half")


@register("recovery_indicators", sql("bd", """a AS (SELECT *, avg(rem_pct) OVER w AS m, stddev_samp(rem_pct) OVER w AS s, lead(rem_pct) OVER (PARTITION BY entity_id ORDER BY day) AS nx FROM bd WINDOW w AS (PARTITION BY entity_id))
    SELECT entity_id, count(*) AS n, count(*) FILTER (WHERE rem_pct < m-s AND nx IS NOT NULL) AS low_nights, count(*) FILTER (WHERE rem_pct < m-s AND nx > m+s) AS rebounds, """
    + ", ".join([R("avg(CASE WHEN deep_pct >= 13 THEN 1.0e0 ELSE 0.0e0 END)*100", "adequacy_pct"), R("sum(total_hours-7)", "debt_hours"), R("stddev_samp(rem_pct)/avg(rem_pct)*100", "rem_cv"), R("arg_max(total_hours, day)", "latest_hours")]) + " FROM a GROUP BY 1"))
def _(spark, d):
    g = C.recovery_indicators(A.bio_daily(spark, d), "rem_pct", "deep_pct", "total_hours")
    return rounded(g, ["entity_id", "n", "low_nights", "rebounds"], "adequacy_pct", "debt_hours", "rem_cv", "latest_hours")


@register("benchmark_norms", sql("bd", "v(metric, low, high) AS (VALUES ('deep_pct', 13.0e0, 23.0e0), ('rem_pct', 20.0e0, 25.0e0), ('efficiency', 85.0e0, 100.0e0)), m AS (" + " UNION ALL ".join(f"SELECT entity_id, '{c}' AS metric, avg({c}) AS mean FROM bd GROUP BY 1" for c in ("deep_pct", "rem_pct", "efficiency"))
    + ") SELECT entity_id, metric, " + R("(mean - (low+high)/2)/((high-low)/2)", "norm_z") + ", mean BETWEEN low AND high AS in_range FROM m JOIN v USING (metric)"))
def _(spark, d):
    from ..sources.tables import to_signals

    rows = [(c, m, lo, hi) for c, ms in C.SLEEP_NORMS.items() for m, (lo, hi) in ms.items()]
    norms = spark.createDataFrame(rows, "cohort STRING, metric STRING, low DOUBLE, high DOUBLE")
    sig = to_signals(A.bio_daily(spark, d), {c: c for c in ("deep_pct", "rem_pct", "efficiency")})
    means = sig.groupBy("entity_id", "metric").agg(F.avg("value").alias("mean"))
    return C.benchmark_norms(means, norms, "general").select("entity_id", "metric", r6("norm_z").alias("norm_z"), "in_range")


@register("skewness", sql("ls", "g AS (SELECT entity_id, metric, avg(value) AS m FROM ls GROUP BY ALL) SELECT entity_id, metric, " + R("avg(pow(value-m,3))/pow(avg(pow(value-m,2)), 1.5)", "skew") + " FROM ls JOIN g USING (entity_id, metric) GROUP BY entity_id, metric"))
def _(spark, d):
    return A.line_signals(spark, d).groupBy("entity_id", "metric").agg(r6(F.skewness("value")).alias("skew"))
