"""Scans, quality, landing, sinks, daily frames, scalars, sets and top-k."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks, scalar as S
from ..operators import daily as D, gaps, quality as Q, windows as Wn
from ..sources import adapters as A, landing, sinks, tables
from .registry import R, register

sql, r6 = A.sql, S.r6


def whole(spark, d):
    """Samples in whole hundredths: their sums are exact in any order."""
    return A.samples(spark, d).withColumn("value", F.col("cents").cast("double"))


# --- scans and filters -------------------------------------------------------

@register("scan_sentinel_filter", sql("ev", "SELECT entity_id, metric, day, cents FROM ev WHERE cents > 1000 AND metric IS NOT NULL"))
def _(spark, d):
    return A.samples(spark, d).where((F.col("cents") > 1000) & F.col("metric").isNotNull()).select("entity_id", "metric", "day", "cents")


@register("date_bounded_scan", """SELECT o_orderpriority AS entity_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS value
    FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31'""")
def _(spark, d):
    # bounds on the raw column, so they reach the reader
    o = A.table(spark, d, "orders").where(F.col("o_orderdate").between(
        F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), F.lit("1998-12-31 00:00:00").cast("timestamp_ntz")))
    return o.select(F.col("o_orderpriority").alias("entity_id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("value"))


@register("keep_last_scan", sql("ev", """SELECT entity_id, day, metric, cents FROM (SELECT *, row_number() OVER
    (PARTITION BY entity_id, day ORDER BY ts DESC, event_id DESC) AS rn FROM ev WHERE metric IN ('click','view')
    AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25') WHERE rn = 1"""))
def _(spark, d):
    ev = tables.between_days(A.samples(spark, d).where(F.col("metric").isin("click", "view")), date(2024, 1, 5), date(2024, 1, 25))
    return sinks.pick_per_key(ev, ["entity_id", "day"], ["ts", "event_id"]).select("entity_id", "day", "metric", "cents")


@register("source_slice", sql("ev", "SELECT day, count(*) AS n, sum(cents)::BIGINT AS cents FROM ev WHERE metric LIKE 'c%' GROUP BY day"))
def _(spark, d):
    ev = A.samples(spark, d).withColumn("source", F.col("metric"))
    return tables.by_source(ev, "c%").groupBy("day").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@register("latest_observed", """SELECT 'events' AS source, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events
    UNION ALL SELECT 'orders', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)) FROM orders
    UNION ALL SELECT 'lineitem', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)) FROM lineitem""")
def _(spark, d):
    frames = {
        name: A.table(spark, d, name).select(F.to_date(c).alias("day"))
        for name, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
    }
    return tables.observed_range(frames)


@register("metric_series", sql("ld", "SELECT entity_id, day, 'qty' AS metric, qty AS value FROM ld WHERE entity_id IN ('A','N') UNION ALL SELECT entity_id, day, 'tax_h', tax/3600 FROM ld WHERE entity_id IN ('A','N')"))
def _(spark, d):
    sig = tables.to_signals(A.line_daily(spark, d).where(F.col("entity_id").isin("A", "N")), {"qty": "qty", "tax_h": "tax"})
    defs = spark.createDataFrame([("qty", None), ("tax_h", "sec_to_hours")], "metric STRING, transform STRING")
    return tables.load_metric(sig, defs).select("entity_id", "day", "metric", "value")


@register("nan_share_guard", sql("ew", "SELECT metric, " + R("avg(CASE WHEN value IS NULL THEN 1.0e0 ELSE 0.0e0 END)", "missing_share") + """,
    avg(CASE WHEN value IS NULL THEN 1.0e0 ELSE 0.0e0 END) <= 0.6 AS usable FROM (""" + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {m} AS value FROM ew" for m in A.EVENT_METRICS) + ") GROUP BY metric"))
def _(spark, d):
    return Q.missing_share(A.event_wide(spark, d), A.EVENT_METRICS, limit=0.6).select("metric", r6("missing_share").alias("missing_share"), "usable")


@register("complete_rows", sql("ew", "SELECT entity_id, day FROM ew WHERE click IS NOT NULL AND view IS NOT NULL"))
def _(spark, d):
    return A.event_wide(spark, d).na.drop(how="any", subset=["click", "view"]).select("entity_id", "day")


# --- quality -----------------------------------------------------------------

@register("completeness", sql("ed", """span AS (SELECT min(day) AS a, max(day) AS b FROM ev),
    per AS (SELECT entity_id, metric, count(*) AS n_days FROM ed GROUP BY ALL)
    SELECT entity_id, metric, n_days, date_diff('day', a, b) + 1 AS calendar_days, """
    + R("CAST(n_days AS DOUBLE)/(date_diff('day', a, b) + 1)", "completeness") + " FROM per, span"))
def _(spark, d):
    return Q.completeness(A.event_daily(spark, d)).select(
        "entity_id", "metric", "n_days", "calendar_days", r6("completeness").alias("completeness"))


@register("range_violations", sql("ev", """SELECT event_id, 'value' AS column_name, value, 'above 100' AS problem FROM ev WHERE value > 100
    UNION ALL SELECT event_id, 'cents', CAST(cents AS DOUBLE), 'below 50' FROM ev WHERE cents < 50"""))
def _(spark, d):
    return Q.range_violations(A.samples(spark, d), {"value": (0, 100, True), "cents": (50, None, True)}, ["event_id"])


@register("period_day_counts", sql("ev", """SELECT metric, count(*) AS n_rows, count(DISTINCT day) AS n_days,
    count(DISTINCT (entity_id, day)) AS n_entity_days FROM ev GROUP BY metric"""))
def _(spark, d):
    return Q.period_day_counts(A.samples(spark, d), ["metric"])


# --- landing -----------------------------------------------------------------

@register("unpack_series", sql("ev", """SELECT event_id, p AS pos, epoch_us(ts) + p*300000000 AS at_us, v AS value FROM
    (SELECT event_id, ts, unnest([value, NULL, value - 20, value*2]) AS v, unnest([0,1,2,3]) AS p FROM ev) WHERE v > 0"""))
def _(spark, d):
    ev = A.samples(spark, d).select("event_id", F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit(None).cast("int").alias("interval"),
        F.array("value", F.lit(None), F.col("value") - 20, F.col("value") * 2).alias("items")).alias("hrv"))
    out = landing.unpack_series(ev, "hrv", "value", ["event_id"], 300)
    return out.select("event_id", "pos", S.epoch_us("ts").alias("at_us"), "value")


@register("unpack_digits", """SELECT o_orderkey, p AS epoch_index, CAST(c AS INTEGER) AS phase FROM (
    SELECT o_orderkey, s[i] AS c, CAST(i-1 AS INTEGER) AS p FROM (
      SELECT o_orderkey, replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '0', '-') AS s,
             unnest(range(1, length(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR))+1)) AS i FROM orders)) WHERE c BETWEEN '0' AND '9'""")
def _(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", F.translate(
        F.format_string("%s", F.col("o_totalprice").cast("decimal(18,2)").cast("string")), "0", "-").alias("text"))
    return landing.unpack_digits(o, "text", "epoch_index", "phase", ["o_orderkey"])


@register("json_props", sql("ev", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events".replace("SELECT", "SELECT", 1)))
def _(spark, d):
    return A.table(spark, d, "events").select("event_id", F.from_json("props", "k INT").getField("k").alias("k"))


# --- sinks -------------------------------------------------------------------

@register("upsert_latest", sql("ev", """SELECT entity_id, day, event_id, cents FROM (SELECT *, row_number() OVER
    (PARTITION BY entity_id, day ORDER BY event_id DESC) AS rn FROM ev) WHERE rn = 1"""))
def _(spark, d):
    ev = A.samples(spark, d).select("entity_id", "day", "event_id", "cents")
    old, new = ev.where(F.col("event_id") % 3 != 0), ev.where(F.col("event_id") % 3 == 0)
    return sinks.upsert_latest(old, new, ["entity_id", "day"], ["event_id"])


@register("insert_absent", sql("ev", """SELECT entity_id, day, event_id, cents FROM (SELECT *, row_number() OVER
    (PARTITION BY entity_id, day ORDER BY ts, event_id) AS rn FROM ev WHERE metric <> 'click') n WHERE rn = 1
    AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.metric = 'click' AND o.entity_id = n.entity_id AND o.day = n.day)"""))
def _(spark, d):
    ev = A.samples(spark, d).select("entity_id", "day", "event_id", "cents", "ts", "metric")
    stored, batch = ev.where("metric = 'click'"), ev.where("metric <> 'click'")
    return sinks.insert_absent(stored, batch, ["entity_id", "day"], ["ts", "event_id"]).select("entity_id", "day", "event_id", "cents")


@register("backfill_nulls", sql("ew", """SELECT entity_id, day, """ + R("coalesce(click, view)", "click") + ", "
    + R("coalesce(nullif(error, 0), signup)", "error") + " FROM ew"))
def _(spark, d):
    w = A.event_wide(spark, d)
    src = w.select("entity_id", "day", "view", "signup")
    out = sinks.backfill(w, src, ["entity_id", "day"], {"click": "view", "error": "signup"}, ["error"])
    return out.select("entity_id", "day", r6("click").alias("click"), r6("error").alias("error"))


@register("manifest_missing", sql("ev", """want AS (SELECT DISTINCT metric || '/' || strftime(day, '%Y-%m-%d') AS artifact FROM ev),
    have AS (SELECT metric || '/' || strftime(day, '%Y-%m-%d') AS artifact, count(*) AS n_rows FROM ev WHERE cents > 9000 GROUP BY 1)
    SELECT artifact, n_rows IS NOT NULL AS present, coalesce(n_rows, 0) AS n_rows FROM want LEFT JOIN have USING (artifact)"""))
def _(spark, d):
    ev = A.samples(spark, d).withColumn("artifact", F.concat_ws("/", "metric", F.col("day").cast("string")))
    return sinks.manifest(ev.select("artifact").distinct(), ev.where("cents > 9000"))


@register("identity_hash", """SELECT c_custkey, substr(sha256(c_name), 1, 16) AS email_key FROM customer""")
def _(spark, d):
    return sinks.replace_person(A.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("email")))


@register("json_nan_null", sql("ld", "SELECT entity_id, day, CASE WHEN qty > 25 THEN qty END AS qty FROM ld"))
def _(spark, d):
    f = A.line_daily(spark, d).select("entity_id", "day", F.when(F.col("qty") > 25, F.col("qty")).otherwise(F.lit(float("nan"))).alias("qty"))
    text = sinks.json_safe(f).select("entity_id", "day", F.to_json(F.struct("qty")).alias("doc"))
    return text.select("entity_id", "day", F.from_json("doc", "qty DOUBLE").getField("qty").alias("qty"))


# --- daily frames ------------------------------------------------------------

@register("daily_agg", sql("ev", "SELECT entity_id, metric, day, count(*) AS n, " + ", ".join([
    R("CAST(sum(cents) AS DOUBLE)/count(*)/100", "mean"), R("stddev_samp(value)", "sd"), R("min(value)", "low"),
    R("max(value)", "high"), R("quantile_cont(value, 0.5)", "median")]) + " FROM ev GROUP BY entity_id, metric, day"))
def _(spark, d):
    return D.daily_stats(A.samples(spark, d), ["entity_id", "metric", "day"]).select(
        "entity_id", "metric", "day", "n", *[r6(c).alias(c) for c in ("mean", "sd", "low", "high", "median")])


@register("spine_left_join", sql("ed", """span AS (SELECT entity_id, min(day) AS a, max(day) AS b FROM ed WHERE metric = 'view' GROUP BY 1),
    spine AS (SELECT entity_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span)
    SELECT s.entity_id, s.day, """ + R("e.value", "value") + " FROM spine s LEFT JOIN ed e ON e.entity_id = s.entity_id AND e.day = s.day AND e.metric = 'view'"))
def _(spark, d):
    v = A.event_daily(spark, d).where("metric = 'view'")
    return gaps.on_calendar(v, ["entity_id"]).select("entity_id", "day", r6("value").alias("value"))


@register("wide_pivot", sql("ew", "SELECT entity_id, day, " + ", ".join(R(m, m) for m in A.EVENT_METRICS) + " FROM ew"))
def _(spark, d):
    return D.widen(A.event_daily(spark, d), A.EVENT_METRICS).select("entity_id", "day", *[r6(m).alias(m) for m in A.EVENT_METRICS])


@register("percentile_block", """SELECT l_returnflag AS entity_id, """ + ", ".join(
    R(f"quantile_cont(l_extendedprice, {p})", n) for n, p in (("p5", .05), ("p25", .25), ("p50", .5), ("p75", .75), ("p95", .95)))
    + " FROM lineitem GROUP BY 1")
def _(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("entity_id"), "l_extendedprice")
    probs = {"p5": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95}
    return ranks.exact_quantiles(li, ["entity_id"], "l_extendedprice", probs).select("entity_id", *[r6(c).alias(c) for c in probs])


@register("hour_profile", sql("ev", """SELECT metric, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, """ + ", ".join([
    R("CAST(sum(cents) AS DOUBLE)/count(*)/100", "mean"), R("stddev_samp(value)", "sd"), R("min(value)", "low"), R("max(value)", "high")])
    + " FROM ev GROUP BY ALL"))
def _(spark, d):
    p = D.hour_profile(whole(spark, d), ["metric"])
    return p.select("metric", "hour", "n", *[r6(F.col(c) / 100).alias(c) for c in ("mean", "sd", "low", "high")])


@register("hourly_min_count", sql("ev", """SELECT metric, CAST(floor(epoch_us(ts)/3600000000.0) AS BIGINT) AS hour_no, count(*) AS n, """
    + R("CAST(sum(cents) AS DOUBLE)/count(*)/100", "value") + " FROM ev GROUP BY ALL HAVING count(*) >= 3"))
def _(spark, d):
    return D.hourly_bins(whole(spark, d), ["metric"], min_count=3).select("metric", "hour_no", "n", r6(F.col("value") / 100).alias("value"))


@register("describe", sql("ls", "SELECT entity_id, metric, count(value) AS n, " + ", ".join([
    R("avg(value)", "mean"), R("quantile_cont(value, 0.5)", "median"), R("stddev_samp(value)", "sd"),
    R("quantile_cont(value, 0.75) - quantile_cont(value, 0.25)", "iqr"), R("min(value)", "low"), R("max(value)", "high")])
    + " FROM ls GROUP BY entity_id, metric"))
def _(spark, d):
    return D.describe(A.line_signals(spark, d), ["entity_id", "metric"]).select(
        "entity_id", "metric", "n", *[r6(c).alias(c) for c in ("mean", "median", "sd", "iqr", "low", "high")])


@register("executive_summary", """SELECT 'events' AS source, count(*) AS n, """ + R("avg(value)", "mean") + ", " + R("max(value)", "high")
    + """, count(*) FILTER (WHERE value > 50) AS n_above, bool_and(value > 0) AS all_positive FROM events
    UNION ALL SELECT 'orders', count(*), """ + R("avg(o_totalprice/100000)", "mean") + ", " + R("max(o_totalprice/100000)", "high")
    + ", count(*) FILTER (WHERE o_totalprice/100000 > 2.5), bool_and(o_totalprice > 0) FROM orders UNION ALL SELECT 'lineitem', count(*), " + R("avg(l_quantity)", "mean") + ", " + R("max(l_quantity)", "high")
    + ", count(*) FILTER (WHERE l_quantity > 25), bool_and(l_quantity > 0) FROM lineitem UNION ALL SELECT 'customer', count(*), " + R("avg(c_acctbal/1000)", "mean") + ", " + R("max(c_acctbal/1000)", "high")
    + ", count(*) FILTER (WHERE c_acctbal/1000 > 5), bool_and(c_acctbal > 0) FROM customer")
def _(spark, d):
    ev = D.summary_line(A.table(spark, d, "events"), "events", F.col("value"), 50)
    od = D.summary_line(A.table(spark, d, "orders"), "orders", F.col("o_totalprice") / 100000, 2.5)
    li = D.summary_line(A.table(spark, d, "lineitem"), "lineitem", F.col("l_quantity"), 25)
    cu = D.summary_line(A.table(spark, d, "customer"), "customer", F.col("c_acctbal") / 1000, 5)
    out = ev.unionAll(od).unionAll(li).unionAll(cu)
    return out.select("source", "n", r6("mean").alias("mean"), r6("high").alias("high"), "n_above", "all_positive")


@register("conditional_counts", sql("ls", "SELECT entity_id, metric, count(*) FILTER (WHERE value > 4) AS n_high, " + R(
    "avg(CASE WHEN value > 4 THEN 1.0e0 ELSE 0.0e0 END)*100", "pct_high") + " FROM ls GROUP BY entity_id, metric"))
def _(spark, d):
    hit = F.col("value") > 4
    return A.line_signals(spark, d).groupBy("entity_id", "metric").agg(
        F.count_if(hit).alias("n_high"), r6(F.avg(hit.cast("double")) * 100).alias("pct_high"))


@register("histogram", sql("ev", "SELECT metric, CAST(floor(value/2.5) AS BIGINT) AS bin, count(*) AS n FROM ev GROUP BY ALL"))
def _(spark, d):
    return D.histogram(A.samples(spark, d), ["metric"], "value", 2.5).select("metric", "bin", "n")


@register("calendar_heatmap", sql("ed", """SELECT metric, CAST(isodow(day)-1 AS INTEGER) AS weekday, CAST(week(day) AS INTEGER) AS week, """ + R("avg(value)", "value") + " FROM ed GROUP BY ALL"))
def _(spark, d):
    return D.calendar_heatmap(A.event_daily(spark, d), ["metric"]).select("metric", "weekday", "week", r6("value").alias("value"))


@register("epoch_profile", sql("ev", """SELECT CASE WHEN day < DATE '2024-01-16' THEN 'pre' ELSE 'post' END AS phase,
    CAST((hour(ts)+2)%24 AS INTEGER) AS night_hour, count(*) AS n, """ + R("CAST(sum(cents) AS DOUBLE)/count(*)/100", "mean") + ", " + R("stddev_samp(value)", "sd")
    + " FROM ev WHERE (hour(ts)+2)%24 < 10 GROUP BY ALL"))
def _(spark, d):
    ev = A.samples(spark, d).withColumn("phase", S.phase_label("day", date(2024, 1, 16))).withColumn("night_hour", S.night_hour("ts"))
    return ev.where("night_hour IS NOT NULL").groupBy("phase", "night_hour").agg(
        F.count("*").alias("n"), r6(F.avg("cents") / 100).alias("mean"), r6(F.stddev_samp("value")).alias("sd"))


# --- scalars -----------------------------------------------------------------

@register("guarded_ratio", sql("ld", "SELECT entity_id, day, " + R("CASE WHEN abs(disc) > 1.0 THEN tax/disc ELSE -1.0e0 END", "ratio") + ", "
    + R("price / nullif(price + qty, 0) * 100", "share") + ", " + R("CASE WHEN tax > 4 THEN disc/tax WHEN disc > 0 THEN 5.0e0 ELSE 1.0e0 END", "strain") + " FROM ld"))
def _(spark, d):
    relief = F.when(F.col("tax") > 4, F.col("tax")).otherwise(F.lit(0.0))
    return A.line_daily(spark, d).select(
        "entity_id", "day", r6(S.safe_ratio("tax", "disc", -1.0, 1.0)).alias("ratio"),
        r6(S.share_pct("price", "price", "qty")).alias("share"), r6(S.strain_ratio("disc", relief)).alias("strain"))


@register("clip_score", sql("ew", "SELECT entity_id, day, " + R("CASE WHEN click IS NOT NULL THEN least(greatest((click-5)/60*100, 0), 100) END", "score") + ", "
    + R("CASE WHEN view IS NOT NULL THEN least(120, greatest(0, view/20*100)) END", "scaled") + ", "
    + R("CASE WHEN click > 0 THEN (click - view)/click*100 END", "dip") + " FROM ew"))
def _(spark, d):
    return A.event_wide(spark, d).select(
        "entity_id", "day", r6(S.linear_score("click", 5, 60)).alias("score"), r6(S.target_scale("view", 20)).alias("scaled"),
        r6(S.dip_pct("click", "view")).alias("dip"))


@register("normal_score", sql("ld", "SELECT entity_id, day, " + R(
    "(" + S.erfc_sql("(-((qty-25.0e0)/5.0e0)/" + repr(2 ** 0.5) + "e0)") + ")*0.5e0*100", "score") + " FROM ld"))
def _(spark, d):
    return A.line_daily(spark, d).select("entity_id", "day", r6(S.norm_score("qty", 25, 5)).alias("score"))


@register("risk_map", sql("ld", "SELECT entity_id, day, " + R("""CASE WHEN disc <= 0 THEN 0.0e0 WHEN disc <= 5 THEN disc/5*30
    WHEN disc <= 15 THEN 30.0e0 + (disc-5)/10*40 WHEN disc <= 30 THEN 70.0e0 + (disc-15)/15*30 ELSE 100.0e0 END""", "risk") + " FROM ld"))
def _(spark, d):
    return A.line_daily(spark, d).select("entity_id", "day", r6(S.piecewise("disc", [(0, 0), (5, 30), (15, 70), (30, 100)])).alias("risk"))


@register("bands", sql("ld", """SELECT entity_id, day, CASE WHEN qty < 20 THEN 'low' WHEN qty < 30 THEN 'mid' ELSE 'high' END AS band,
    CASE WHEN disc-5 > 1 THEN 'fever' WHEN disc-5 > 0.5 THEN 'mild_elevation' WHEN disc-5 >= -0.5 THEN 'normal'
         WHEN disc-5 >= -1 THEN 'mild_low' ELSE 'hypothermia' END AS temperature FROM ld"""))
def _(spark, d):
    return A.line_daily(spark, d).select(
        "entity_id", "day", S.bands("qty", [(20, "low"), (30, "mid")], "high").alias("band"),
        S.temperature_band(F.col("disc") - 5).alias("temperature"))


@register("phase_label", sql("od", """SELECT entity_id, day, date_diff('day', DATE '1998-06-01', day) AS days_since,
    CASE WHEN day < DATE '1998-06-01' THEN 'pre' WHEN day < DATE '1999-06-01' THEN 'mid' ELSE 'post' END AS phase FROM od"""))
def _(spark, d):
    return A.order_daily(spark, d).select(
        "entity_id", "day", S.days_since("day", date(1998, 6, 1)).cast("bigint").alias("days_since"),
        S.phase_label("day", date(1998, 6, 1), date(1999, 6, 1)).alias("phase"))


@register("weekday_weekend", sql("od", """SELECT entity_id, isodow(day) IN (5, 6) AS weekend, count(*) AS n, """ + R("avg(value)", "mean") + " FROM od GROUP BY ALL"))
def _(spark, d):
    return A.order_daily(spark, d).groupBy("entity_id", S.is_weekend_night("day").alias("weekend")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@register("day_keys", sql("ev", """SELECT event_id, CAST(ts AS DATE) AS wall_day, CAST(ts - INTERVAL 2 HOUR AS DATE) AS utc_day,
    CAST(ts - INTERVAL 1 HOUR AS DATE) AS zone_day FROM ev"""))
def _(spark, d):
    ev = A.samples(spark, d).withColumn("raw", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    return ev.select("event_id", S.day_key("raw", "wall").alias("wall_day"), S.day_key("raw", "utc").alias("utc_day"), S.day_key("raw", "zone", "Europe/Oslo").alias("zone_day"))


@register("clock_features", sql("ev", """SELECT event_id, """ + R("CASE WHEN hour(ts) < 12 THEN hour(ts)+minute(ts)/60.0e0+24 ELSE hour(ts)+minute(ts)/60.0e0 END", "late_hour")
    + ", CASE WHEN metric = 'click' THEN 'one' WHEN metric = 'view' THEN 'two' END AS label FROM ev"))
def _(spark, d):
    return A.samples(spark, d).select("event_id", r6(S.late_hour("ts")).alias("late_hour"), S.code_label("metric", {"click": "one", "view": "two"}).alias("label"))


@register("kpi_states", sql("ld", """SELECT entity_id, day, CASE WHEN qty >= 30 THEN 'critical' WHEN qty >= 25 THEN 'warning' ELSE 'good' END AS load_state,
    CASE WHEN tax <= 3 THEN 'critical' WHEN tax <= 4 THEN 'warning' ELSE 'good' END AS reserve_state, (price - 45.0e0)/15.0e0 AS norm_z FROM ld"""))
def _(spark, d):
    return A.line_daily(spark, d).select(
        "entity_id", "day", S.kpi_status("qty", 25, 30).alias("load_state"), S.kpi_status("tax", 4, 3).alias("reserve_state"),
        S.norm_range_z("price", 30, 60).alias("norm_z"))


# --- sets and top-k ----------------------------------------------------------

@register("spine_union", sql("ev", "SELECT CAST(ts AS DATE) AS day FROM events UNION SELECT CAST(o_orderdate AS DATE) FROM orders"))
def _(spark, d):
    return D.day_universe([A.samples(spark, d).select("day"), A.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))])


@register("overlap_days", sql("od", "SELECT day FROM od GROUP BY day HAVING count(DISTINCT entity_id) = (SELECT count(DISTINCT entity_id) FROM od)"))
def _(spark, d):
    return D.overlap_days(A.order_daily(spark, d))


@register("day_intersection", sql("ev", "SELECT entity_id, day FROM ev WHERE metric='click' INTERSECT SELECT entity_id, day FROM ev WHERE metric='error'"))
def _(spark, d):
    ev = A.samples(spark, d)
    return ev.where("metric='click'").select("entity_id", "day").intersect(ev.where("metric='error'").select("entity_id", "day"))


@register("day_difference", sql("ev", """a AS (SELECT DISTINCT entity_id, day FROM ev WHERE metric='click'), b AS (SELECT DISTINCT entity_id, day FROM ev WHERE metric='error')
    SELECT *, 'gone' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""))
def _(spark, d):
    ev = A.samples(spark, d)
    return D.differences(ev.where("metric='click'"), ev.where("metric='error'"), ["entity_id", "day"])


@register("series_concat", sql("od ld", """SELECT entity_id, day, value AS price, CAST(NULL AS DOUBLE) AS qty FROM od
    UNION ALL SELECT entity_id, day, CAST(NULL AS DOUBLE), qty FROM ld"""))
def _(spark, d):
    a = A.order_daily(spark, d).select("entity_id", "day", F.col("value").alias("price"))
    return a.unionByName(A.line_daily(spark, d).select("entity_id", "day", "qty"), allowMissingColumns=True)


@register("top_k_days", sql("ld", "SELECT entity_id, day, " + R("price", "price") + " FROM ld ORDER BY ld.price DESC, entity_id, day LIMIT 10"))
def _(spark, d):
    return A.line_daily(spark, d).orderBy(F.desc("price"), "entity_id", "day").limit(10).select("entity_id", "day", r6("price").alias("price"))


@register("top_k_per_group", sql("ls", """SELECT entity_id, metric, day, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER
    (PARTITION BY entity_id, metric ORDER BY abs(value) DESC, day) AS rn FROM ls) WHERE rn <= 3"""))
def _(spark, d):
    return D.top_per_group(A.line_signals(spark, d), ["entity_id", "metric"], [F.abs("value").desc(), F.col("day")], 3).select("entity_id", "metric", "day", "place")


@register("argmax_day", sql("ls", """SELECT entity_id, metric, arg_max(day, (value, day)) AS peak_day, arg_min(day, (value, day)) AS trough_day FROM ls GROUP BY ALL"""))
def _(spark, d):
    key = F.struct("value", "day")
    return A.line_signals(spark, d).groupBy("entity_id", "metric").agg(F.max_by("day", key).alias("peak_day"), F.min_by("day", key).alias("trough_day"))


@register("head_tail", sql("ls", """SELECT entity_id, metric, """ + R("avg(value) FILTER (WHERE a <= 14)", "first_mean") + ", " + R("avg(value) FILTER (WHERE b <= 14)", "last_mean")
    + """ FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, metric ORDER BY day) AS a,
    row_number() OVER (PARTITION BY entity_id, metric ORDER BY day DESC) AS b FROM ls) GROUP BY entity_id, metric"""))
def _(spark, d):
    by = ["entity_id", "metric"]
    s = A.line_signals(spark, d).withColumn("a", Wn.first_rows(by, 14)).withColumn("b", Wn.last_rows(by, 14))
    return s.groupBy(*by).agg(r6(F.avg(F.when(F.col("a"), F.col("value")))).alias("first_mean"), r6(F.avg(F.when(F.col("b"), F.col("value")))).alias("last_mean"))
