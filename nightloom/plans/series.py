"""Joins, windows, control charts and state runs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks, scalar as S
from ..operators import gaps, joins as J, nights as N, spc, windows as W
from ..sources import adapters as A, sinks
from .registry import R, register

sql, r6 = A.sql, S.r6
EM = ["entity_id", "metric"]
WIN = "(PARTITION BY entity_id, metric ORDER BY day"


def us_samples(spark, d):
    return A.samples(spark, d).withColumn("at_us", S.epoch_us("ts"))


def long_sessions(spark, d):
    return gaps.gap_sessions(A.samples(spark, d), ["entity_id"], gap_s=21600)


# --- joins -------------------------------------------------------------------

@register("gap_sessions", sql("ev", """SELECT entity_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY entity_id ORDER BY us, event_id) AS s FROM (
      SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY entity_id ORDER BY us, event_id) > 1800000000 THEN 1 ELSE 0 END AS fresh
      FROM (SELECT entity_id, event_id, cents, epoch_us(ts) AS us FROM ev))) GROUP BY entity_id, s HAVING count(*) >= 2"""))
def _(spark, d):
    out = gaps.gap_sessions(A.samples(spark, d), ["entity_id"], gap_s=1800, sums={"cents": F.col("cents")})
    return out.select("entity_id", "start_us", "end_us", "n", "cents")


@register("interval_join", sql("se", """SELECT s.entity_id, s.start_us, count(*) AS n_views, """ + R("avg(v.value)", "mean")
    + " FROM se s JOIN ev v ON v.entity_id = s.entity_id AND v.metric = 'view' AND epoch_us(v.ts) BETWEEN s.start_us AND s.end_us GROUP BY ALL"))
def _(spark, d):
    views = us_samples(spark, d).where("metric = 'view'").select("entity_id", "at_us", "value")
    hit = J.interval_join(views, long_sessions(spark, d).select("entity_id", "start_us", "end_us"))
    return hit.groupBy("entity_id", "start_us").agg(F.count("*").alias("n_views"), r6(F.avg("value")).alias("mean"))


@register("epoch_lookup", sql("se", """, hit AS (SELECT s.entity_id, s.session, s.start_us, v.metric, v.value, v.event_id, epoch_us(v.ts) AS us,
      CAST(floor((epoch_us(v.ts) - s.start_us)/300000000.0) AS BIGINT) AS epoch_index
      FROM se s JOIN ev v ON v.entity_id = s.entity_id AND epoch_us(v.ts) BETWEEN s.start_us AND s.end_us),
    code AS (SELECT entity_id, session, epoch_index, arg_max(metric, (us, event_id)) AS stage FROM hit GROUP BY ALL)
    SELECT c.stage, count(*) AS n, """.lstrip(", ") + R("avg(h.value)", "mean") + " FROM hit h JOIN code c USING (entity_id, session, epoch_index) GROUP BY c.stage"))
def _(spark, d):
    ses = long_sessions(spark, d).select("entity_id", "start_us", "end_us", F.concat_ws("-", "entity_id", "session").alias("period_id"))
    hit = J.interval_join(us_samples(spark, d).select("entity_id", "at_us", "value", "metric", "event_id"), ses)
    epoch = J.epoch_of(F.col("at_us"), F.col("start_us"))
    stages = hit.groupBy("period_id", epoch.alias("epoch_index")).agg(F.max_by("metric", F.struct("at_us", "event_id")).alias("stage"))
    out = J.epoch_lookup(hit.drop("metric", "entity_id"), stages)
    return out.groupBy("stage").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@register("stage_stats", sql("ev", "SELECT metric, count(*) AS n, " + ", ".join([
    R("avg(value)", "mean"), R("stddev_pop(value)", "sd"), R("quantile_cont(value,0.5)", "median"),
    R("quantile_cont(value,0.25)", "p25"), R("quantile_cont(value,0.75)", "p75")]) + " FROM ev GROUP BY metric"))
def _(spark, d):
    g = N.stage_stats(A.samples(spark, d), ["metric"], "value")
    return g.select("metric", "n", *[r6(c).alias(c) for c in ("mean", "sd", "median", "p25", "p75")])


def month_epochs(line):
    month = F.year("day") * 12 + F.month("day")
    m = line.groupBy("entity_id", month.alias("m")).agg(F.avg("qty").alias("q"))
    w = Window.partitionBy("entity_id").orderBy("m")
    return m.select("entity_id", (F.row_number().over(w) - 1).alias("epoch_index"), S.bands("q", [(25.0, "light"), (26.0, "medium")], "deep").alias("stage"))


@register("slot_ratio_join", sql("ld", """slots AS (SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY day) - 1 AS i,
      CASE WHEN tax < 3.5 THEN 'still' WHEN tax < 4.5 THEN 'restless' ELSE 'active' END AS label FROM ld),
    eps AS (SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY m) - 1 AS e,
      CASE WHEN q < 25 THEN 'light' WHEN q < 26 THEN 'medium' ELSE 'deep' END AS stage
      FROM (SELECT entity_id, year(day)*12+month(day) AS m, avg(qty) AS q FROM ld GROUP BY ALL)),
    last AS (SELECT entity_id, max(e) AS k FROM eps GROUP BY 1)
    SELECT stage, label, count(*) AS n FROM slots s JOIN last l USING (entity_id) JOIN eps p ON p.entity_id = s.entity_id AND p.e = least(s.i // 10, l.k) GROUP BY ALL"""))
def _(spark, d):
    line = A.line_daily(spark, d)
    pos = F.row_number().over(Window.partitionBy("entity_id").orderBy("day")) - 1
    slots = line.select("entity_id", pos.alias("i"), S.bands("tax", [(3.5, "still"), (4.5, "restless")], "active").alias("label"))
    return J.slot_ratio_join(slots, month_epochs(line), "entity_id", "i", "epoch_index").groupBy("stage", "label").agg(F.count("*").alias("n"))


@register("tolerance_join", sql("ed", """SELECT a.entity_id, a.day, count(*) AS n, """ + R("avg(b.value)", "mean") + """ FROM ed a JOIN ed b
    ON a.entity_id = b.entity_id AND abs(date_diff('day', a.day, b.day)) <= 3 WHERE a.metric = 'click' AND a.value > 60 AND b.metric = 'error' GROUP BY ALL"""))
def _(spark, d):
    ed = A.event_daily(spark, d)
    spikes = ed.where("metric = 'click' AND value > 60").select("entity_id", "day")
    errors = ed.where("metric = 'error'").select("entity_id", "day", "value")
    return J.tolerance_join(spikes, errors, ["entity_id"], 3).groupBy("entity_id", "day").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@register("nearest_measurement", sql("ed", """SELECT a.entity_id, a.day, arg_min(b.day, (abs(date_diff('day', a.day, b.day)), date_diff('day', a.day, b.day))) AS other_day, """
    + R("arg_min(b.value, (abs(date_diff('day', a.day, b.day)), date_diff('day', a.day, b.day)))", "value") + """ FROM ed a JOIN ed b
    ON a.entity_id = b.entity_id AND abs(date_diff('day', a.day, b.day)) <= 7 WHERE a.metric = 'click' AND a.value > 60 AND b.metric = 'view' GROUP BY ALL"""))
def _(spark, d):
    ed = A.event_daily(spark, d)
    spikes = ed.where("metric = 'click' AND value > 60").select("entity_id", "day")
    out = J.nearest_in_time(spikes, ed.where("metric = 'view'").select("entity_id", "day", "value"), ["entity_id"], 7, "value")
    return out.select("entity_id", "day", "other_day", r6("value").alias("value"))


@register("nearest_boundary", sql("ed", """v AS (SELECT entity_id, day, lag(day) OVER (PARTITION BY entity_id ORDER BY day) AS p FROM ed WHERE metric = 'view'),
    b AS (SELECT entity_id, p AS day, 'gap_start' AS kind FROM v WHERE date_diff('day', p, day) > 3
          UNION ALL SELECT entity_id, day, 'gap_end' FROM v WHERE date_diff('day', p, day) > 3),
    x AS (SELECT DISTINCT entity_id, day FROM ed)
    SELECT x.entity_id, x.day, min(abs(date_diff('day', x.day, b.day))) AS distance_days
    FROM x LEFT JOIN b USING (entity_id) GROUP BY x.entity_id, x.day"""))
def _(spark, d):
    ed = A.event_daily(spark, d)
    gap = J.wear_gaps(ed.where("metric = 'view'"), ["entity_id"], min_gap=3)
    out = J.nearest_boundary(ed.select("entity_id", "day").distinct(), J.gap_boundaries(gap, ["entity_id"]), ["entity_id"])
    return out.select("entity_id", "day", "distance_days")


@register("lag_pairs_rows", sql("ld", "SELECT entity_id, day, qty AS x, lead(disc, 2) OVER (PARTITION BY entity_id ORDER BY day) AS y FROM ld"))
def _(spark, d):
    return J.lag_pairs_rows(A.line_daily(spark, d), "qty", "disc", ["entity_id"], 2)


@register("lag_pairs_days", sql("od", "SELECT a.entity_id, a.day, a.value AS x, b.value AS y FROM od a LEFT JOIN od b ON a.entity_id = b.entity_id AND b.day = a.day + INTERVAL 1 DAY"))
def _(spark, d):
    return J.lag_pairs_days(A.order_daily(spark, d), "value", "value", ["entity_id"], 1)


@register("anti_keys", "SELECT c_custkey AS entity_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, d):
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id")).join(
        A.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("entity_id")), "entity_id", "left_anti")


@register("semi_keys", sql("ed", "SELECT entity_id, metric, day FROM ed WHERE (entity_id, day) IN (SELECT entity_id, day FROM ed WHERE metric = 'click' AND value > 60)"))
def _(spark, d):
    ed = A.event_daily(spark, d)
    return ed.join(ed.where("metric = 'click' AND value > 60").select("entity_id", "day"), ["entity_id", "day"], "left_semi").select(*EM, "day")


@register("dimension_join", """SELECT c_mktsegment, n_name, count(*) AS n, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def _(spark, d):
    facts = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "n_nationkey")
    out = J.small_dimension(facts, A.table(spark, d, "nation"), ["n_nationkey"])
    return out.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.sum(A.hundredths("o_totalprice")).alias("cents"))


@register("anomaly_enrich", sql("ed ew", "SELECT a.entity_id, a.day, w.error, coalesce(w.view, w.signup) AS view FROM ed a LEFT JOIN ew w USING (entity_id, day) WHERE a.metric = 'click' AND a.value > 60"))
def _(spark, d):
    wide = A.event_wide(spark, d)
    rows = A.event_daily(spark, d).where("metric = 'click' AND value > 60").select("entity_id", "day")
    out = J.enrich(rows, wide, ["error", "view"])
    return J.fill_from(out, wide.select("entity_id", "day", F.col("signup").alias("view")), "view")


# --- windows -----------------------------------------------------------------

@register("rolling_mean_min", sql("ed", "SELECT entity_id, metric, day, " + R(f"CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END", "mean7")
    + f" FROM ed WINDOW w AS {WIN} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"))
def _(spark, d):
    return A.event_daily(spark, d).select(*EM, "day", r6(W.roll_mean("value", W.trailing(EM, 7), 3)).alias("mean7"))


@register("rolling_mean_days", sql("ed", "SELECT entity_id, metric, day, " + R("avg(value) OVER w", "mean7") + ", count(*) OVER w AS n"
    + f" FROM ed WINDOW w AS {WIN} RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)"))
def _(spark, d):
    w = W.trailing(EM, 7, mode="days")
    return A.event_daily(spark, d).select(*EM, "day", r6(W.roll_mean("value", w)).alias("mean7"), F.count("*").over(w).alias("n"))


@register("rolling_cv", sql("ls", "SELECT entity_id, metric, day, " + R("CASE WHEN count(value) OVER w >= 4 THEN stddev_samp(value) OVER w / abs(avg(value) OVER w) * 100 END", "cv")
    + f" FROM ls WINDOW w AS {WIN} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"))
def _(spark, d):
    return A.line_signals(spark, d).select(*EM, "day", r6(W.roll_cv("value", W.trailing(EM, 7), 4)).alias("cv"))


@register("rolling_slope", sql("ed", """x AS (SELECT *, row_number() OVER (PARTITION BY entity_id, metric ORDER BY day) AS rn,
    CASE WHEN n < 2 THEN value END AS y FROM ed) SELECT entity_id, metric, day, """
    + R("CASE WHEN count(*) OVER w = 7 AND count(y) OVER w >= 3 THEN regr_slope(y, rn) OVER w END", "slope")
    + f" FROM x WINDOW w AS {WIN} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"))
def _(spark, d):
    x = A.event_daily(spark, d).withColumn("rn", F.row_number().over(W.series(EM))).withColumn("y", F.when(F.col("n") < 2, F.col("value")))
    return x.select(*EM, "day", r6(W.roll_slope("y", "rn", W.trailing(EM, 7), 7)).alias("slope"))


@register("rolling_corr", sql("ld", "SELECT entity_id, day, " + R("CASE WHEN count(*) OVER w = 14 THEN corr(qty, price) OVER w END", "r")
    + " FROM ld WINDOW w AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"))
def _(spark, d):
    return A.line_daily(spark, d).select("entity_id", "day", r6(W.roll_corr("qty", "price", W.trailing(["entity_id"], 14), 14)).alias("r"))


@register("centred_mean", sql("ls", "SELECT entity_id, metric, day, " + R("avg(value) OVER w", "smooth") + ", " + "value - lag(value) OVER (PARTITION BY entity_id, metric ORDER BY day) AS change"
    + f" FROM ls WINDOW w AS {WIN} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"))
def _(spark, d):
    return A.line_signals(spark, d).select(*EM, "day", r6(F.avg("value").over(W.centred(EM, 3))).alias("smooth"), W.step_change("value", EM).alias("change"))


@register("rolling_flags", sql("ls", "SELECT entity_id, metric, day, CAST(sum(CASE WHEN value < 4 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS low7"
    + f" FROM ls WINDOW w AS {WIN} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"))
def _(spark, d):
    return A.line_signals(spark, d).select(*EM, "day", W.roll_sum((F.col("value") < 4).cast("int"), W.trailing(EM, 7)).alias("low7"))


@register("rolling_band", sql("ls", "SELECT entity_id, metric, day, " + ", ".join([R("m", "mean"), R("m - s", "lower"), R("m + s", "upper")])
    + f" FROM (SELECT *, CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END AS m, CASE WHEN count(value) OVER w >= 3 THEN stddev_samp(value) OVER w END AS s FROM ls WINDOW w AS {WIN} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"))
def _(spark, d):
    return W.rolling_band(A.line_signals(spark, d), "value", EM).select(*EM, "day", *[r6(c).alias(c) for c in ("mean", "lower", "upper")])


BASE_Z = """SELECT entity_id, metric, day, (value - m) / CASE WHEN s IS NULL OR s = 0 THEN 1 ELSE s END AS z FROM (SELECT *,
    avg(value) FILTER (WHERE day < DATE '2024-01-16') OVER (PARTITION BY entity_id, metric) AS m,
    stddev_samp(value) FILTER (WHERE day < DATE '2024-01-16') OVER (PARTITION BY entity_id, metric) AS s FROM ed)"""


def baseline_z(ed):
    return W.z_score("value", EM, F.col("day") < F.lit(date(2024, 1, 16)))


@register("baseline_z", sql("ed", "SELECT entity_id, metric, day, " + R("z", "z") + f" FROM ({BASE_Z})"))
def _(spark, d):
    return A.event_daily(spark, d).select(*EM, "day", r6(baseline_z(None)).alias("z"))


@register("pct_of_self", sql("ls", "SELECT entity_id, metric, day, " + R(
    "(rank() OVER (PARTITION BY entity_id, metric ORDER BY value) + (count(*) OVER (PARTITION BY entity_id, metric, value) - 1)/2.0e0) / count(*) OVER (PARTITION BY entity_id, metric) * 100", "pct") + " FROM ls"))
def _(spark, d):
    return A.line_signals(spark, d).select(*EM, "day", r6(ranks.percent_of_self("value", EM)).alias("pct"))


@register("interpolate_limit", sql("ed", """span AS (SELECT entity_id, min(day) AS a, max(day) AS b FROM ed WHERE metric = 'view' GROUP BY 1),
    spine AS (SELECT entity_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
    v AS (SELECT * FROM ed WHERE metric = 'view'),
    f AS (SELECT s.entity_id, s.day, (SELECT max(day) FROM v WHERE v.entity_id = s.entity_id AND v.day <= s.day) AS d0,
          (SELECT min(day) FROM v WHERE v.entity_id = s.entity_id AND v.day >= s.day) AS d1 FROM spine s)
    SELECT f.entity_id, f.day, """ + R("""CASE WHEN f.day = d0 THEN v0.value WHEN date_diff('day', d0, f.day) <= 3 OR date_diff('day', f.day, d1) <= 3
      THEN v0.value + (v1.value - v0.value) * date_diff('day', d0, f.day) / date_diff('day', d0, d1) END""", "filled") + """
    FROM f LEFT JOIN v v0 ON v0.entity_id = f.entity_id AND v0.day = d0 LEFT JOIN v v1 ON v1.entity_id = f.entity_id AND v1.day = d1"""))
def _(spark, d):
    v = A.event_daily(spark, d).where("metric = 'view'").select("entity_id", "day", "value")
    return gaps.interpolate(gaps.on_calendar(v, ["entity_id"]), "value", ["entity_id"]).select("entity_id", "day", r6("filled").alias("filled"))


@register("carry_fill", sql("ed", """span AS (SELECT entity_id, min(day) AS a, max(day) AS b FROM ed WHERE metric = 'view' GROUP BY 1),
    spine AS (SELECT entity_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span)
    SELECT s.entity_id, s.day, """ + R("last_value(e.value IGNORE NULLS) OVER (PARTITION BY s.entity_id ORDER BY s.day)", "filled")
    + " FROM spine s LEFT JOIN ed e ON e.entity_id = s.entity_id AND e.day = s.day AND e.metric = 'view'"))
def _(spark, d):
    v = A.event_daily(spark, d).where("metric = 'view'").select("entity_id", "day", "value")
    return gaps.carry(gaps.on_calendar(v, ["entity_id"]), "value", ["entity_id"]).select("entity_id", "day", r6("filled").alias("filled"))


@register("best_period", sql("ev", """SELECT entity_id, day, event_id, metric FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, day
    ORDER BY (metric = 'view') DESC, cents DESC, event_id) AS rn FROM ev) WHERE rn = 1"""))
def _(spark, d):
    ev = A.samples(spark, d).select("entity_id", "day", "event_id", "metric", "cents")
    return sinks.pick_per_key(ev, ["entity_id", "day"], [F.col("metric") == "view", "cents", -F.col("event_id")]).select("entity_id", "day", "event_id", "metric")


@register("half_split_flags", sql("ls", """h AS (SELECT *, row_number() OVER (PARTITION BY entity_id, metric ORDER BY day) <= count(*) OVER (PARTITION BY entity_id, metric) // 2 AS e FROM ls),
    g AS (SELECT entity_id, metric, avg(CASE WHEN value > 4 THEN 1.0e0 ELSE 0.0e0 END) FILTER (WHERE e) AS r0, avg(CASE WHEN value > 4 THEN 1.0e0 ELSE 0.0e0 END) FILTER (WHERE NOT e) AS r1,
      stddev_samp(value) FILTER (WHERE e) AS s0, stddev_samp(value) FILTER (WHERE NOT e) AS s1 FROM h GROUP BY ALL)
    SELECT entity_id, metric, """ + ", ".join([R("r0", "rate_first"), R("r1", "rate_second"), R("s0", "sd_first"), R("s1", "sd_second")]) + ", r1 > r0*1.5 AS rate_up, s1 > s0*1.3 AS spread_up FROM g"))
def _(spark, d):
    g = W.split_half_flags(A.line_signals(spark, d), "value", EM, F.col("value") > 4)
    return g.select(*EM, *[r6(c).alias(c) for c in ("rate_first", "rate_second", "sd_first", "sd_second")], "rate_up", "spread_up")


# --- control charts ----------------------------------------------------------

SPC_BASE = """rn AS (SELECT *, row_number() OVER (PARTITION BY entity_id, metric ORDER BY day) AS rn FROM ls),
    sp AS (SELECT *, avg(value) FILTER (WHERE rn <= 14) OVER (PARTITION BY entity_id, metric) AS mu,
    stddev_pop(value) FILTER (WHERE rn <= 14) OVER (PARTITION BY entity_id, metric) AS sigma FROM rn)"""


@register("shewhart", sql("ls", SPC_BASE + "SELECT entity_id, metric, day, " + R("(value-mu)/sigma", "z") + ", abs((value-mu)/sigma) > 2 AS warn, abs((value-mu)/sigma) > 3 AS action FROM sp"))
def _(spark, d):
    return spc.shewhart(A.line_signals(spark, d), "value", EM).select(*EM, "day", r6("z").alias("z"), "warn", "action")


@register("spc_score", sql("ls", SPC_BASE + "SELECT entity_id, day, " + R("max(least(abs((value-mu)/sigma)/3, 1.5))", "score") + " FROM sp GROUP BY entity_id, day"))
def _(spark, d):
    return spc.daily_score(spc.shewhart(A.line_signals(spark, d), "value", EM)).select("entity_id", "day", r6("score").alias("score"))


CHAIN = ", " + """chain AS (SELECT entity_id, metric, rn, day, mu, sigma, value, 0.0e0 AS pos, 0.0e0 AS neg, value AS ew, 0.0e0 AS rp, 0.0e0 AS rq, false AS hit FROM sp WHERE rn = 1
    UNION ALL SELECT s.entity_id, s.metric, s.rn, s.day, s.mu, s.sigma, s.value,
      greatest(0.0e0, c.pos + s.value - s.mu - 0.5e0*s.sigma), greatest(0.0e0, c.neg - s.value + s.mu - 0.5e0*s.sigma),
      0.2e0*s.value + 0.8e0*c.ew,
      CASE WHEN c.hit THEN greatest(0.0e0, (s.value-s.mu)/s.sigma - 0.5e0) ELSE greatest(0.0e0, c.rp + (s.value-s.mu)/s.sigma - 0.5e0) END,
      CASE WHEN c.hit THEN greatest(0.0e0, -(s.value-s.mu)/s.sigma - 0.5e0) ELSE greatest(0.0e0, c.rq - (s.value-s.mu)/s.sigma - 0.5e0) END,
      (CASE WHEN c.hit THEN greatest(0.0e0, (s.value-s.mu)/s.sigma - 0.5e0) ELSE greatest(0.0e0, c.rp + (s.value-s.mu)/s.sigma - 0.5e0) END) > 4
      OR (CASE WHEN c.hit THEN greatest(0.0e0, -(s.value-s.mu)/s.sigma - 0.5e0) ELSE greatest(0.0e0, c.rq - (s.value-s.mu)/s.sigma - 0.5e0) END) > 4
    FROM chain c JOIN sp s ON s.entity_id = c.entity_id AND s.metric = c.metric AND s.rn = c.rn + 1)
    """


@register("cusum", sql("ls", SPC_BASE + CHAIN + "SELECT entity_id, metric, day, " + R("pos", "cusum_pos") + ", " + R("neg", "cusum_neg") + ", (pos > 4*sigma OR neg > 4*sigma) AS alarm FROM chain", recursive=True))
def _(spark, d):
    return spc.cusum(A.line_signals(spark, d), "value", EM).select(*EM, "day", r6("cusum_pos").alias("cusum_pos"), r6("cusum_neg").alias("cusum_neg"), "alarm")


@register("cusum_reset", sql("ls", SPC_BASE + CHAIN + "SELECT entity_id, metric, day FROM chain WHERE hit", recursive=True))
def _(spark, d):
    return spc.cusum_reset(A.line_signals(spark, d), "value", EM).select(*EM, "day")


@register("ewma", sql("ls", SPC_BASE + CHAIN + "SELECT entity_id, metric, day, " + R("ew", "ewma") + ", " + R("mu + 3*sigma*sqrt((0.2e0/1.8e0)*(1-pow(0.8e0, 2*rn)))", "ucl")
    + ", (ew > mu + 3*sigma*sqrt((0.2e0/1.8e0)*(1-pow(0.8e0, 2*rn))) OR ew < mu - 3*sigma*sqrt((0.2e0/1.8e0)*(1-pow(0.8e0, 2*rn)))) AS violation FROM chain", recursive=True))
def _(spark, d):
    return spc.ewma(A.line_signals(spark, d), "value", EM).select(*EM, "day", r6("ewma").alias("ewma"), r6("ucl").alias("ucl"), "violation")


@register("roll_ttest_cp", sql("ls", """x AS (SELECT *, row_number() OVER (PARTITION BY entity_id, metric ORDER BY day) AS rn, count(*) OVER (PARTITION BY entity_id, metric) AS n,
      avg(value) OVER b AS m0, var_samp(value) OVER b AS v0, avg(value) OVER a AS m1, var_samp(value) OVER a AS v1 FROM ls
      WINDOW b AS (PARTITION BY entity_id, metric ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY entity_id, metric ORDER BY day ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING))
    SELECT entity_id, metric, day, """ + R("(m0-m1)/sqrt((v0+v1)/14)", "t") + ", " + R("abs(m1-m0)/sqrt((v0+v1)/2)", "d") + ", " + R("13*(v0+v1)*(v0+v1)/(v0*v0+v1*v1)", "df")
    + " FROM x WHERE rn > 14 AND rn <= n - 14"))
def _(spark, d):
    return spc.rolling_shift(A.line_signals(spark, d), "value", EM).select(*EM, "day", r6("t").alias("t"), r6("d").alias("d"), r6("df").alias("df"))


@register("cusum_inflection", sql("ls", """c AS (SELECT *, value - avg(value) OVER (PARTITION BY entity_id, metric) AS c FROM ls),
    k AS (SELECT *, sum(c) OVER w AS cum, sign(lead(c,2) OVER w - lead(c,1) OVER w) AS h, sign(lead(c,1) OVER w - c) AS p, row_number() OVER w AS rn
      FROM c WINDOW w AS (PARTITION BY entity_id, metric ORDER BY day)),
    s AS (SELECT *, stddev_pop(cum) OVER (PARTITION BY entity_id, metric) AS sd FROM k)
    SELECT entity_id, metric, day, """ + R("cum", "cum", 5) + " FROM s WHERE h <> p AND rn > 1 AND abs(cum) >= 0.5*sd"))
def _(spark, d):
    return spc.cusum_inflection(A.line_signals(spark, d), "value", EM).select(*EM, "day", r6("cum", 5).alias("cum"))


# --- state runs --------------------------------------------------------------

ALERTS = """p AS (SELECT entity_id, day, disc/12 AS p_pre, greatest(0, tax-6)/12 AS p_active FROM ld),
    f AS (SELECT *, (p_pre > 0.5 OR p_active > 0.2) AS red, NOT (p_pre > 0.5 OR p_active > 0.2) AND p_pre > 0.3 AS up FROM p),
    g AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id ORDER BY day) AS run FROM f),
    h AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, run ORDER BY day) AS k FROM g),
    al AS (SELECT entity_id, day, CASE WHEN red THEN 'RED' ELSE 'YELLOW' END AS level FROM h WHERE red OR (up AND k = 3))"""


def alerts(spark, d):
    p = A.line_daily(spark, d).select("entity_id", "day", (F.col("disc") / 12).alias("p_pre"), (F.greatest(F.lit(0.0), F.col("tax") - 6) / 12).alias("p_active"))
    return spc.alert_machine(p, ["entity_id"]).select("entity_id", "day", "level")


@register("alert_runs", sql("ld", ALERTS + " SELECT entity_id, day, level FROM al"))
def _(spark, d):
    return alerts(spark, d)


@register("alert_validation", sql("ld", ALERTS + """ SELECT entity_id, min(day) FILTER (WHERE level='RED' AND day <= DATE '1998-06-01') AS first_red,
    min(day) FILTER (WHERE level='YELLOW' AND day <= DATE '1998-06-01') AS first_yellow,
    count(*) FILTER (WHERE level='RED' AND abs(date_diff('day', day, DATE '1998-06-01')) <= 3) AS red_in_window,
    count(*) FILTER (WHERE level='RED' AND abs(date_diff('day', day, DATE '1998-06-01')) > 3) AS red_outside,
    date_diff('day', min(day) FILTER (WHERE level='RED' AND day <= DATE '1998-06-01'), DATE '1998-06-01') AS red_lead_days FROM al GROUP BY entity_id"""))
def _(spark, d):
    ev = A.line_daily(spark, d).select("entity_id").distinct().withColumn("event_date", F.lit(date(1998, 6, 1)))
    out = spc.alert_validation(alerts(spark, d), ev, ["entity_id"])
    return out.select("entity_id", "first_red", "first_yellow", "red_in_window", "red_outside", "red_lead_days")


@register("condition_spans", sql("ls", """c AS (SELECT *, value > 5 AS hit FROM ls), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, metric ORDER BY day)
    - row_number() OVER (PARTITION BY entity_id, metric, hit ORDER BY day) AS g FROM c)
    SELECT entity_id, metric, min(day) AS start_day, max(day) AS end_day, count(*) AS n FROM r WHERE hit GROUP BY entity_id, metric, g"""))
def _(spark, d):
    return gaps.runs(A.line_signals(spark, d), F.col("value") > 5, EM).select(*EM, "start_day", "end_day", "n")


EPL = "pl AS (SELECT *, lag(phase) OVER (PARTITION BY entity_id, week_no ORDER BY epoch_index) AS prev FROM ep)"


@register("fragmentation", sql("ep", EPL + """, g AS (SELECT entity_id, week_no, count(*) FILTER (WHERE prev = 4 AND phase IN (1,2,3)) AS wakes, count(*) FILTER (WHERE phase <> prev) AS transitions,
    count(*) AS n_epochs, count(*) FILTER (WHERE phase <> 4) AS a, count(*) FILTER (WHERE phase = 4) AS k FROM pl GROUP BY ALL)
    SELECT entity_id, week_no, wakes, transitions, n_epochs, """ + ", ".join([R("CASE WHEN a > 0 THEN wakes/(a/12.0e0) END", "per_sleep_hour"), R("transitions/(n_epochs/12.0e0)", "per_hour"), R("k/n_epochs*100.0e0", "awake_pct")]) + " FROM g"))
def _(spark, d):
    g = N.fragmentation(A.epochs(spark, d), ["entity_id", "week_no"])
    return g.select("entity_id", "week_no", "wakes", "transitions", "n_epochs", *[r6(c).alias(c) for c in ("per_sleep_hour", "per_hour", "awake_pct")])


@register("transition_matrix", sql("ep", EPL + """, s AS (SELECT unnest([1,2,3,4]) AS v), c AS (SELECT prev, phase, count(*) AS n FROM pl WHERE prev IS NOT NULL GROUP BY ALL)
    SELECT CAST(a.v AS INTEGER) AS from_phase, CAST(b.v AS INTEGER) AS to_phase, coalesce(n, 0) AS n, """ + R("coalesce(n, 0) / CAST(sum(coalesce(n,0)) OVER (PARTITION BY a.v) AS DOUBLE)", "p")
    + " FROM s a, s b LEFT JOIN c ON c.prev = a.v AND c.phase = b.v"))
def _(spark, d):
    return N.transition_matrix(A.epochs(spark, d), ["entity_id", "week_no"]).select("from_phase", "to_phase", "n", r6("p").alias("p"))


@register("phase_share", sql("ep", "SELECT phase, count(*) AS n, " + R("count(*) / sum(count(*)) OVER () * 100.0e0", "pct") + " FROM ep GROUP BY phase"))
def _(spark, d):
    g = N.phase_share(A.epochs(spark, d).withColumn("all_rows", F.lit(1)), ["all_rows"])
    return g.select("phase", "n", r6("pct").alias("pct"))


@register("first_latency", sql("ep", """o AS (SELECT entity_id, week_no, min(epoch_index) FILTER (WHERE phase IN (1,2,3)) AS onset FROM ep GROUP BY ALL),
    r AS (SELECT e.entity_id, e.week_no, min(epoch_index) AS rem FROM ep e JOIN o USING (entity_id, week_no) WHERE phase = 3 AND epoch_index >= onset GROUP BY ALL)
    SELECT entity_id, week_no, CAST((rem - onset)*5 AS BIGINT) AS latency_min FROM o LEFT JOIN r USING (entity_id, week_no) WHERE onset IS NOT NULL"""))
def _(spark, d):
    return N.rem_latency(A.epochs(spark, d), ["entity_id", "week_no"]).select("entity_id", "week_no", F.col("latency_min").cast("bigint").alias("latency_min"))


@register("cycles", sql("ep", """en AS (SELECT *, row_number() OVER (PARTITION BY entity_id, week_no ORDER BY epoch_index) - 1 AS "at" FROM ep),
    m AS (SELECT entity_id, week_no, count(*) AS n FROM en GROUP BY ALL),
    st AS (SELECT entity_id, week_no, 0 AS i, CAST(NULL AS BIGINT) AS s, false AS rem, CAST(NULL AS BIGINT) AS done, CAST(NULL AS BIGINT) AS pi FROM m
     UNION ALL SELECT t.entity_id, t.week_no, t.i + 1,
       CASE WHEN e.phase IN (1,2) AND (t.rem OR t.s IS NULL) THEN e.epoch_index WHEN e.phase = 3 THEN coalesce(t.s, e.epoch_index) WHEN e.phase = 4 AND t.rem THEN NULL ELSE t.s END,
       CASE WHEN e.phase = 3 THEN true ELSE false END, CASE WHEN e.phase <> 3 AND t.rem THEN (t.pi + 1 - t.s)*5 END, e.epoch_index
     FROM st t JOIN en e ON e.entity_id = t.entity_id AND e.week_no = t.week_no AND e."at" = t.i),
    fin AS (SELECT entity_id, week_no, done FROM st WHERE done IS NOT NULL UNION ALL SELECT st.entity_id, st.week_no, (pi + 1 - s)*5 FROM st JOIN m ON m.entity_id = st.entity_id AND m.week_no = st.week_no AND st.i = m.n WHERE rem)
    SELECT entity_id, week_no, count(*) AS cycle_count, CAST(sum(done) AS BIGINT) AS total_min FROM fin GROUP BY ALL""", recursive=True))
def _(spark, d):
    c = N.sleep_cycles(A.epochs(spark, d), ["entity_id", "week_no"])
    return c.groupBy("entity_id", "week_no").agg(F.count("*").alias("cycle_count"), F.sum("minutes").alias("total_min"))


@register("movement_bins", sql("ep", """x AS (SELECT *, row_number() OVER (PARTITION BY entity_id, week_no ORDER BY epoch_index) - 1 AS pos, count(*) OVER (PARTITION BY entity_id, week_no) AS n FROM ep),
    b AS (SELECT entity_id, week_no, least(pos // (n // 8), 7) AS bin, avg(phase) AS m FROM x WHERE n >= 8 GROUP BY ALL)
    SELECT bin, count(*) AS n_periods, """ + R("avg(m)", "intensity") + " FROM b GROUP BY bin"))
def _(spark, d):
    mv = A.epochs(spark, d).withColumnRenamed("phase", "classification").withColumnRenamed("epoch_index", "movement_index")
    return N.movement_by_bin(mv, ["entity_id", "week_no"]).select("bin", "n_periods", r6("intensity").alias("intensity"))


@register("restlessness", sql("ep", "SELECT entity_id, week_no, count(*) AS n, " + R("avg(CASE WHEN phase >= 2 THEN 1.0e0 ELSE 0.0e0 END)", "restlessness") + " FROM ep GROUP BY ALL"))
def _(spark, d):
    mv = A.epochs(spark, d).withColumnRenamed("phase", "classification")
    return N.restlessness(mv, ["entity_id", "week_no"]).select("entity_id", "week_no", "n", r6("restlessness").alias("restlessness"))


@register("night_terrain", sql("se", """h AS (SELECT s.entity_id, s.session, CAST(floor((epoch_us(v.ts) - s.start_us)/300000000.0) AS BIGINT) AS bin, v.value
      FROM se s JOIN ev v ON v.entity_id = s.entity_id AND epoch_us(v.ts) BETWEEN s.start_us AND s.end_us),
    g AS (SELECT entity_id, session, bin, avg(value) AS v FROM h WHERE bin BETWEEN 0 AND 119 GROUP BY ALL),
    full_ AS (SELECT entity_id, session, unnest(range(min(bin), max(bin)+1)) AS bin FROM g GROUP BY entity_id, session),
    f AS (SELECT full_.*, g.v, last_value(g.v IGNORE NULLS) OVER w AS v0, last_value(g.bin IGNORE NULLS) OVER w AS b0,
      first_value(g.v IGNORE NULLS) OVER x AS v1, first_value(g.bin IGNORE NULLS) OVER x AS b1
      FROM full_ LEFT JOIN g USING (entity_id, session, bin)
      WINDOW w AS (PARTITION BY full_.entity_id, full_.session ORDER BY full_.bin), x AS (PARTITION BY full_.entity_id, full_.session ORDER BY full_.bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT entity_id, session, bin, """ + R("coalesce(v, v0 + (v1-v0)*(bin-b0)/(b1-b0))", "value", 9) + " FROM f"))
def _(spark, d):
    ses = long_sessions(spark, d).select("entity_id", "session", "start_us", "end_us")
    hit = J.interval_join(us_samples(spark, d).select("entity_id", "at_us", "value"), ses)
    out = N.night_grid(hit, ["entity_id", "session"], "value", (F.col("at_us") - F.col("start_us")) / F.lit(60_000_000))
    return out.select("entity_id", "session", "bin", r6("value", 9).alias("value"))


# --- flagship ----------------------------------------------------------------

FLAG = f"""m AS (SELECT entity_id, metric, day, value, CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END AS mean7 FROM ed WINDOW w AS {WIN} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
    z AS ({BASE_Z}),
    s AS (SELECT entity_id, day, count(*) AS n_metrics, sum(CASE WHEN abs(z) > 2 THEN 1 ELSE 0 END)::BIGINT AS n_flagged, max(least(abs(z)/3, 1.5)) AS score, max(mean7) AS top_mean7
      FROM z JOIN m USING (entity_id, metric, day) GROUP BY ALL),
    r AS (SELECT *, rank() OVER (PARTITION BY entity_id ORDER BY round(score, 9) DESC) AS place FROM s)
    SELECT entity_id, day, n_metrics, n_flagged, """ + R("score", "score") + ", " + R("top_mean7", "top_mean7") + ", place FROM r WHERE place <= 5"


@register("flagship", sql("ed", FLAG))
def _(spark, d):
    """Daily means, trailing mean, baseline z, flags, and each entity's five worst days."""
    ed = A.event_daily(spark, d).withColumn("z", baseline_z(None)).withColumn("mean7", W.roll_mean("value", W.trailing(EM, 7), 3))
    s = ed.groupBy("entity_id", "day").agg(
        F.count("*").alias("n_metrics"), F.count_if(F.abs("z") > 2).alias("n_flagged"),
        F.max(F.least(F.abs("z") / 3, F.lit(1.5))).alias("score"), F.max("mean7").alias("top_mean7"))
    place = F.rank().over(Window.partitionBy("entity_id").orderBy(F.round("score", 9).desc())).cast("bigint")
    return s.withColumn("place", place).where("place <= 5").select("entity_id", "day", "n_metrics", "n_flagged", r6("score").alias("score"), r6("top_mean7").alias("top_mean7"), "place")


@register("epoch_period_join", sql("ep", """p AS (SELECT user_id AS entity_id, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))/7.0) AS BIGINT) AS week_no, count(*) AS n_rows FROM events GROUP BY ALL)
    SELECT week_no, phase, count(*) AS n_epochs, CAST(sum(n_rows) AS BIGINT) AS period_rows FROM ep JOIN p USING (entity_id, week_no) GROUP BY ALL"""))
def _(spark, d):
    """Epoch rows with columns of their period."""
    periods = A.samples(spark, d).groupBy("entity_id", F.floor(F.unix_date("day") / 7).alias("week_no")).agg(F.count("*").alias("n_rows"))
    j = A.epochs(spark, d).join(periods, ["entity_id", "week_no"])
    return j.groupBy("week_no", "phase").agg(F.count("*").alias("n_epochs"), F.sum("n_rows").alias("period_rows"))


@register("zone_hours", sql("ev", "SELECT CAST((hour(ts)+1)%24 AS INTEGER) AS local_hour, count(*) AS n FROM ev GROUP BY 1"))
def _(spark, d):
    local = S.zone_clock("ts", "Europe/Oslo")
    return A.samples(spark, d).groupBy(F.hour(local).alias("local_hour")).agg(F.count("*").alias("n"))


@register("resting_level", sql("ev", "SELECT entity_id, metric, " + R("quantile_cont(value, 0.1)", "resting") + " FROM ev GROUP BY ALL"))
def _(spark, d):
    from ..operators.daily import resting_level

    return resting_level(A.samples(spark, d), ["entity_id", "metric"], "value").select("entity_id", "metric", r6("resting").alias("resting"))
