"""Impact, links, latent states and forecasts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import scalar as S, tails
from ..operators import daily as D, effects as E, impact as I
from ..sources import adapters as A
from .registry import R, register
from .stats import rounded

sql, r6 = A.sql, S.r6
EM = ["entity_id", "metric"]
CUT = date(1998, 6, 1)


def _impact_sql(src: str, extra: str = "", event: str = "DATE '1998-06-01'") -> str:
    k = "entity_id, metric" + extra
    return f"""b AS (SELECT {k}, day, value, CAST(date_diff('day', DATE '1970-01-01', day) AS DOUBLE) AS t, isodow(day) AS wd, day < {event} AS pre FROM {src}),
    lw AS (SELECT {k}, wd, count(*) AS nw, avg(t) AS tw, avg(value) AS yw, regr_sxx(value,t) AS sxx, regr_sxy(value,t) AS sxy, regr_syy(value,t) AS syy FROM b WHERE pre GROUP BY {k}, wd),
    f AS (SELECT {k}, sum(nw) AS n_pre, sum(sxy)/sum(sxx) AS slope, sum(sxx) AS sxx, (sum(syy) - sum(sxy)*sum(sxy)/sum(sxx))/(sum(nw) - count(*) - 1) AS s2, CAST(sum(nw) AS BIGINT) - count(*) - 1 AS dof FROM lw GROUP BY {k}),
    pw AS (SELECT {k}, wd, count(*) AS mw, avg(t) AS tp, sum(value) AS ys FROM b WHERE NOT pre GROUP BY {k}, wd),
    j AS (SELECT {k}, pw.mw, ys, nw, yw + f.slope*(tp-tw) AS pred, tp - tw AS far, f.n_pre, f.sxx, f.s2, f.dof FROM pw JOIN lw USING ({k}, wd) JOIN f USING ({k})),
    g AS (SELECT {k}, CAST(max(n_pre) AS BIGINT) AS n_pre, CAST(max(dof) AS BIGINT) AS dof, CAST(sum(mw) AS BIGINT) AS n_post, sum(ys)/sum(mw) AS actual, sum(mw*pred)/sum(mw) AS predicted,
      sqrt(max(s2)*(1.0e0/sum(mw) + sum(mw*mw/CAST(nw AS DOUBLE))/(CAST(sum(mw) AS DOUBLE)*sum(mw)) + pow(sum(mw*far)/sum(mw), 2)/max(sxx))) AS se FROM j GROUP BY {k})"""


@register("impact", sql("ls", _impact_sql("ls") + " SELECT entity_id, metric, n_pre, n_post, " + ", ".join([
    R("actual", "actual"), R("predicted", "predicted"), R("actual-predicted", "effect"), R("se", "se"), R(tails.t_p2_sql("((actual-predicted)/se)", "dof"), "p"),
    R(f"actual-predicted-{tails.t975_sql('dof')}*se", "ci_lo"), R(f"actual-predicted+{tails.t975_sql('dof')}*se", "ci_hi")])
    + f", abs(actual-predicted) >= 1e-10 AND 2*{tails.t975_sql('dof')}*se > 5*abs(actual-predicted) AS low_confidence FROM g"))
def _(spark, d):
    return rounded(I.impact(A.line_signals(spark, d), EM, F.lit(CUT)), [*EM, "n_pre", "n_post", "low_confidence"], "actual", "predicted", "effect", "se", "p", "ci_lo", "ci_hi")


@register("impact_series", sql("ls", _impact_sql("ls") + """, o AS (SELECT b.entity_id, b.metric, b.day, b.value, yw + slope*(b.t-tw) AS pred, """ + tails.t975_sql("f.dof") + """*sqrt(s2*(1 + 1.0e0/nw + (b.t-tw)*(b.t-tw)/f.sxx)) AS half
    FROM b JOIN lw ON lw.entity_id = b.entity_id AND lw.metric = b.metric AND lw.wd = b.wd JOIN f ON f.entity_id = b.entity_id AND f.metric = b.metric)
    SELECT entity_id, metric, day, """ + ", ".join([R("pred", "pred"), R("pred-half", "lo"), R("pred+half", "hi")]) + " FROM o"))
def _(spark, d):
    return rounded(I.impact_series(A.line_signals(spark, d), EM, F.lit(CUT)), [*EM, "day"], "pred", "lo", "hi")


PLACEBO = """r AS (SELECT *, min(day) OVER w AS a, max(day) OVER w AS b FROM ls WHERE day < DATE '1998-06-01' WINDOW w AS (PARTITION BY entity_id, metric)),
    pl AS (SELECT entity_id, metric, day, value, a + CAST(floor(date_diff('day', a, b)*s) AS INTEGER) AS pd FROM r, (SELECT unnest([0.25e0, 0.5e0, 0.75e0]) AS s)), """ \
    + _impact_sql("pl", ", pd", "pd")


@register("placebo", sql("ls", PLACEBO + " SELECT entity_id, metric, pd AS placebo_date, n_pre, n_post, " + R("actual-predicted", "effect") + ", " + R("se", "se") + " FROM g"))
def _(spark, d):
    return rounded(I.placebo(A.line_signals(spark, d), EM, F.lit(CUT)), [*EM, "placebo_date", "n_pre", "n_post"], "effect", "se")


@register("placebo_verdict", sql("ls", PLACEBO + ", v AS (SELECT entity_id, " + tails.t_p2_sql("((actual-predicted)/se)", "dof") + """ < 0.05 AS s FROM g WHERE n_pre >= 14 AND n_post >= 3)
    SELECT entity_id, count(*) AS n_tests, count(*) FILTER (WHERE s) AS n_significant, CASE count(*) FILTER (WHERE s) WHEN 0 THEN 'PASS' WHEN 1 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM v GROUP BY 1"""))
def _(spark, d):
    return I.placebo_verdict(I.placebo(A.line_signals(spark, d), EM, F.lit(CUT)), ["entity_id"])


@register("effect_forest", sql("ls", _impact_sql("ls") + ", v AS (SELECT entity_id, metric, actual, predicted, " + tails.t_p2_sql("((actual-predicted)/se)", "dof") + " AS p FROM g) SELECT entity_id, metric, " + R("p", "p")
    + ", CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS tier, " + R("greatest(-80, least(80, (actual-predicted)/abs(predicted)*100))", "effect") + " FROM v"))
def _(spark, d):
    """Impact effects in one table with tiers and capped relative effects."""
    imp = I.impact(A.line_signals(spark, d), EM, F.lit(CUT)).withColumnsRenamed({"relative_pct": "pct_change", "predicted": "m1", "actual": "m2"})
    return E.forest_table(imp).select(*EM, r6("p").alias("p"), "tier", r6("effect").alias("effect"))


_LM = ["disc", "price", "qty", "tax"]
LAGS = 7


def _links_sql(where: str) -> str:
    past = ", ".join(f"lag({m}, {k}) OVER w AS {m}_{k}" for m in _LM for k in range(1, LAGS + 2))
    cells = " UNION ALL ".join(f"SELECT entity_id, '{x}' AS source, '{y}' AS target, {k} AS lag, {x}_{k} AS x, {y} AS y, {y}_1 AS a, {x}_{k + 1} AS b FROM pa" for x in _LM for y in _LM if x != y for k in range(1, LAGS + 1))
    part = lambda r, p, q: f"(({r}) - ({p})*({q}))/sqrt((1-({p})*({p}))*(1-({q})*({q})))"
    return f"""pa AS (SELECT entity_id, {', '.join(_LM)}, {past} FROM ld {where} WINDOW w AS (PARTITION BY entity_id ORDER BY day)), ce AS ({cells}),
    co AS (SELECT entity_id, source, target, lag, count(*) AS n, {', '.join(f'corr({p[0]},{p[1]}) AS {p}' for p in ('xy', 'xa', 'xb', 'ya', 'yb', 'ab'))} FROM ce WHERE x IS NOT NULL AND b IS NOT NULL AND a IS NOT NULL GROUP BY ALL),
    p1 AS (SELECT *, {part('xy', 'xa', 'ya')} AS pxy, {part('xb', 'xa', 'ab')} AS pxb, {part('yb', 'ya', 'ab')} AS pyb FROM co), li AS (SELECT *, {part('pxy', 'pxb', 'pyb')} AS r FROM p1)"""


@register("causal_links", sql("ld", _links_sql("") + " SELECT entity_id, source, target, CAST(lag AS INTEGER) AS lag, n, " + R("r", "r") + ", " + R("r*sqrt((n-4)/(1-r*r))", "t") + ", " + R(tails.t_p2_sql("(r*sqrt((n-4)/(1-r*r)))", "(n-4)"), "p") + " FROM li"))
def _(spark, d):
    return rounded(I.lagged_links(A.line_daily(spark, d), _LM, ["entity_id"], LAGS), ["entity_id", "source", "target", "lag", "n"], "r", "t", "p")


def _side(where: str, name: str) -> str:
    text = _links_sql(where)
    for c in ("pa", "ce", "co", "p1", "li"):
        text = text.replace(f"{c} AS (", f"{c}_{name} AS (").replace(f"FROM {c} ", f"FROM {c}_{name} ").replace(f"FROM {c})", f"FROM {c}_{name})")
    return text


@register("link_changes", sql("ld", _side("", "full") + ", " + _side("WHERE day < DATE '1998-06-01'", "pre") + ", " + ", ".join(
    f"s_{n} AS (SELECT entity_id, source, target, lag FROM li_{n} WHERE {tails.t_p2_sql('(r*sqrt((n-4)/(1-r*r)))', '(n-4)')} < 0.05)" for n in ("full", "pre"))
    + """ SELECT entity_id, source, target, CAST(lag AS INTEGER) AS lag, 'new' AS change FROM (SELECT * FROM s_full EXCEPT SELECT * FROM s_pre)
    UNION ALL SELECT entity_id, source, target, CAST(lag AS INTEGER), 'lost' FROM (SELECT * FROM s_pre EXCEPT SELECT * FROM s_full)"""))
def _(spark, d):
    line = A.line_daily(spark, d)
    full = I.lagged_links(line, _LM, ["entity_id"], LAGS)
    pre = I.lagged_links(line.where(F.col("day") < F.lit(CUT)), _LM, ["entity_id"], LAGS)
    return I.link_changes(full, pre, ["entity_id"])


# --- forecasts ---------------------------------------------------------------

FC = """a AS (SELECT entity_id, metric, day, value AS actual, lag(value) OVER w AS l, lag(value, 7) OVER w AS s7,
      first_value(value) OVER b AS f0, count(*) OVER b AS nb FROM ls WINDOW w AS (PARTITION BY entity_id, metric ORDER BY day), b AS (PARTITION BY entity_id, metric ORDER BY day ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING)),
    m AS (SELECT entity_id, metric, day, actual, 'naive' AS model, l AS pred FROM a WHERE l IS NOT NULL UNION ALL SELECT entity_id, metric, day, actual, 'seasonal', s7 FROM a WHERE s7 IS NOT NULL
      UNION ALL SELECT entity_id, metric, day, actual, 'trend', l + 0.9e0*coalesce((l - f0)/nullif(nb-1, 0), 0) FROM a WHERE l IS NOT NULL),
    e AS (SELECT *, actual - pred AS err FROM m),
    q AS (SELECT *, quantile_cont(err, 0.05) OVER b AS q05, quantile_cont(err, 0.25) OVER b AS q25, quantile_cont(err, 0.75) OVER b AS q75, quantile_cont(err, 0.95) OVER b AS q95, count(err) OVER b AS ne FROM e
      WINDOW b AS (PARTITION BY entity_id, metric, model ORDER BY day ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING)),
    fc AS (SELECT *, pred+q05 AS lo90, pred+q25 AS lo50, pred+q75 AS hi50, pred+q95 AS hi90, actual < pred+q05 OR actual > pred+q95 AS outside FROM q WHERE ne >= 10)"""


def forecasts(spark, d):
    return I.one_step_forecasts(A.line_signals(spark, d), EM)


# the small addend takes values that lie on a rounding limit to one side in both engines
@register("forecast_naive", sql("ls", FC + " SELECT entity_id, metric, day, model, " + ", ".join(["pred", R("lo90+1e-11", "lo90", 9), R("hi90+1e-11", "hi90", 9)]) + ", outside FROM fc"))
def _(spark, d):
    return forecasts(spark, d).select(*EM, "day", "model", "pred", r6(F.col("lo90") + 1e-11, 9).alias("lo90"), r6(F.col("hi90") + 1e-11, 9).alias("hi90"), "outside")


@register("forecast_scores", sql("ls", FC + " SELECT entity_id, metric, model, count(*) AS n, " + ", ".join([
    R("avg(abs(actual-pred))", "mae"), R("sqrt(avg((actual-pred)*(actual-pred)))", "rmse"), R("avg(abs(actual-pred)/nullif(abs(actual),0))*100", "mape"), R("1 - sum((actual-pred)*(actual-pred))/(var_pop(actual)*count(*))", "r2"),
    R("avg(CASE WHEN actual BETWEEN lo50 AND hi50 THEN 1.0e0 ELSE 0.0e0 END)", "cover50"), R("avg(CASE WHEN actual BETWEEN lo90 AND hi90 THEN 1.0e0 ELSE 0.0e0 END)", "cover90"), R("avg(hi90-lo90)", "width90")]) + ", count(*) FILTER (WHERE outside) AS n_outside FROM fc GROUP BY ALL"))
def _(spark, d):
    g = I.forecast_scores(forecasts(spark, d), [*EM, "model"])
    return rounded(g, [*EM, "model", "n", "n_outside"], "mae", "rmse", "mape", "r2", "cover50", "cover90", "width90")


@register("consensus_flag", sql("ls", FC + " SELECT entity_id, metric, day, CASE sum(outside::INT) WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'NORMAL' END AS consensus FROM fc WHERE model IN ('seasonal', 'trend') GROUP BY ALL HAVING count(*) = 2"))
def _(spark, d):
    f = forecasts(spark, d)
    return I.consensus_flag(f.where("model = 'seasonal'"), f.where("model = 'trend'"), EM)


@register("width_change", sql("ls", FC + " SELECT entity_id, metric, model, " + ", ".join([R("avg(hi90-lo90) FILTER (WHERE day < DATE '1998-06-01')", "width_pre"), R("avg(hi90-lo90) FILTER (WHERE day >= DATE '1998-06-01')", "width_post"),
    R("avg(outside::INT) FILTER (WHERE day >= DATE '1998-06-01')", "outside_post")]) + " FROM fc GROUP BY ALL"))
def _(spark, d):
    return rounded(I.width_change(forecasts(spark, d), [*EM, "model"], F.lit(CUT)), [*EM, "model"], "width_pre", "width_post", "outside_post")


@register("horizon_forecast", sql("ls", """p AS (SELECT *, row_number() OVER (PARTITION BY entity_id, metric ORDER BY day DESC) AS k FROM ls WHERE day <= DATE '2001-05-01'),
    s AS (SELECT *, value - lag(value) OVER (PARTITION BY entity_id, metric ORDER BY day) AS st FROM p WHERE k <= 55),
    g AS (SELECT entity_id, metric, arg_max(value, day) AS l, max(day) AS d, avg(st) AS dr, stddev_samp(st) AS sd FROM s GROUP BY ALL), h AS (SELECT *, unnest(range(1, 15)) AS k FROM g)
    SELECT entity_id, metric, CAST(k AS INTEGER) AS step, d + CAST(k AS INTEGER) AS day, """ + ", ".join([R("l + dr*(1-pow(0.9e0,k))/0.1e0*0.9e0", "pred"), R("l + dr*(1-pow(0.9e0,k))/0.1e0*0.9e0 - 1.6448536269514722e0*sd*sqrt(k)", "lo90")]) + " FROM h"))
def _(spark, d):
    f = I.horizon_forecast(A.line_signals(spark, d), EM, F.lit(date(2001, 5, 1)))
    return f.select(*EM, "step", "day", r6("pred").alias("pred"), r6("lo90").alias("lo90"))


@register("retrospective_forecast", sql("ls", """p AS (SELECT *, row_number() OVER (PARTITION BY entity_id, metric ORDER BY day DESC) AS k FROM ls WHERE day <= DATE '1998-05-31'),
    s AS (SELECT *, value - lag(value) OVER (PARTITION BY entity_id, metric ORDER BY day) AS st FROM p WHERE k <= 55),
    g AS (SELECT entity_id, metric, arg_max(value, day) AS l, max(day) AS d, avg(st) AS dr, stddev_samp(st) AS sd FROM s GROUP BY ALL), h AS (SELECT *, unnest(range(1, 15)) AS k FROM g),
    f AS (SELECT entity_id, metric, k, d + CAST(k AS INTEGER) AS day, l + dr*(1-pow(0.9e0,k))/0.1e0*0.9e0 AS pred, 1.6448536269514722e0*sd*sqrt(k) AS w FROM h)
    SELECT f.entity_id, f.metric, f.day, CAST(k AS INTEGER) AS step, """ + R("pred", "pred") + ", v.value < pred-w OR v.value > pred+w AS outside FROM f JOIN ls v ON v.entity_id = f.entity_id AND v.metric = f.metric AND v.day = f.day"))
def _(spark, d):
    """Forecast made the day before the known event against what followed, with scores of both sides."""
    sig = A.line_signals(spark, d)
    f = I.horizon_forecast(sig, EM, F.lit(date(1998, 5, 31)))
    j = f.join(sig.withColumnRenamed("value", "actual"), [*EM, "day"])
    out = j.withColumn("outside", (F.col("actual") < F.col("lo90")) | (F.col("actual") > F.col("hi90")))
    return out.select(*EM, "day", "step", r6("pred").alias("pred"), "outside")


BT = """h AS (SELECT metric, CAST(floor(epoch_us(ts)/3600000000.0) AS BIGINT) AS hn, CAST(sum(cents) AS DOUBLE)/count(*)/100 AS y FROM ev GROUP BY ALL HAVING count(*) >= 2),
    d AS (SELECT *, hn // 24 AS d, hn % 24 AS hod FROM h),
    s AS (SELECT *, avg(y) OVER (PARTITION BY metric, hod ORDER BY d RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS p FROM d),
    c AS (SELECT a.metric, a.d, count(*) AS n, avg(b.y) AS m, stddev_samp(b.y) AS sd FROM (SELECT DISTINCT metric, d FROM d) a JOIN d b ON a.metric = b.metric AND b.d BETWEEN a.d - 7 AND a.d - 1 GROUP BY ALL)"""


@register("backtest", sql("ev", BT + " SELECT metric, hn AS hour_no, n AS n_context, " + R("coalesce(p, m)", "pred") + ", " + R("sd", "sd") + ", abs(y - coalesce(p, m)) > 1.2815515655446004e0*sd AS outside FROM s JOIN c USING (metric, d) WHERE n >= 24"))
def _(spark, d):
    ev = A.samples(spark, d).withColumn("value", F.col("cents").cast("double"))
    h = D.hourly_bins(ev, ["metric"], min_count=2).withColumn("value", F.col("value") / 100)
    return I.hourly_backtest(h, ["metric"]).select("metric", "hour_no", "n_context", r6("pred").alias("pred"), r6("sd").alias("sd"), "outside")
