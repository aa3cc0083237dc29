"""Streaming plans: run on what is available, then compared with their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources import adapters as A
from ..streaming import charts, ingest as IN
from .registry import R, register

sql, r6 = A.sql, S.r6


def stream(spark, d):
    return IN.sample_stream(IN.file_stream(spark, d, "events.parquet"))


def us(c):
    return F.unix_micros(c)


@register("stream_dedup", sql("ev", "SELECT event_id, entity_id, cents FROM ev"))
def _(spark, d):
    """Every third row arrives twice."""
    again = stream(spark, d).where(F.col("event_id") % 3 == 0)
    out = IN.dedup(stream(spark, d).unionByName(again), ["event_id"])
    return IN.run_available(out, "dedup").select("event_id", "entity_id", "cents")


WM = "(SELECT max(epoch_us(ts)) FROM ev) - 259200000000"


@register("stream_tumbling", sql("ev", f"""h AS (SELECT metric, CAST(floor(epoch_us(ts)/3600000000.0) AS BIGINT) AS hour_no, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM ev GROUP BY ALL)
    SELECT metric, hour_no, n, cents FROM h WHERE n >= 3 AND (hour_no+1)*3600000000 <= {WM}"""))
def _(spark, d):
    out = IN.run_available(IN.tumbling(stream(spark, d), ["metric"], min_count=3, sums=["cents"]), "tumbling")
    return out.select("metric", F.floor(us("window_start") / F.lit(3_600_000_000)).alias("hour_no"), "n", "cents")


@register("stream_sliding", sql("ev", f"""k AS (SELECT metric, cents, date_diff('day', DATE '1970-01-01', day) AS dn FROM ev), e AS (SELECT metric, cents, unnest(range(dn-6, dn+1)) AS start_day FROM k)
    SELECT metric, start_day, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM e WHERE (start_day+7)*86400000000 <= {WM} GROUP BY ALL"""))
def _(spark, d):
    out = IN.run_available(IN.tumbling(stream(spark, d), ["metric"], "7 days", slide="1 day", sums=["cents"]), "sliding")
    return out.select("metric", F.floor(us("window_start") / F.lit(86_400_000_000)).alias("start_day"), "n", "cents")


@register("stream_sessions", sql("se", f"SELECT entity_id, start_us, end_us, n FROM se WHERE end_us + 21600000000 <= {WM}"))
def _(spark, d):
    out = IN.run_available(IN.sessions(stream(spark, d), ["entity_id"], gap="6 hours"), "sessions")
    return out.select("entity_id", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"), "n")


@register("stream_upsert", sql("ev", "SELECT entity_id, day, arg_max(event_id, event_id) AS event_id, arg_max(cents, event_id) AS cents FROM ev GROUP BY entity_id, day"))
def _(spark, d):
    rows = stream(spark, d).select("entity_id", F.to_date("ts").alias("day"), "event_id", "cents")
    return IN.upsert_stream(rows, "upsert", ["entity_id", "day"], ["event_id"]).select("entity_id", "day", "event_id", "cents")


@register("stream_enrich", """SELECT event_id, c_mktsegment AS segment FROM events LEFT JOIN customer ON c_custkey = user_id""")
def _(spark, d):
    dim = A.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("segment"))
    return IN.run_available(IN.enrich(stream(spark, d), dim, ["entity_id"]), "enrich").select("event_id", "segment")


@register("stream_quality", sql("ev", "SELECT value BETWEEN 0.5 AND 60 AS valid, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM ev GROUP BY 1"))
def _(spark, d):
    good, bad = IN.quality_stream(stream(spark, d), "quality", {"value": (0.5, 60, False)})
    part = lambda f, ok: f.groupBy(F.lit(ok).alias("valid")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return part(good, True).unionByName(part(bad, False))


@register("stream_spc", sql("ev", f"""h AS (SELECT metric, CAST(floor(epoch_us(ts)/3600000000.0) AS BIGINT) AS h, CAST(sum(cents) AS DOUBLE)/count(*)/100 AS x FROM ev GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY h) AS rn FROM h WHERE (h+1)*3600000000 <= {WM}),
    b AS (SELECT *, avg(x) FILTER (WHERE rn <= 14) OVER (PARTITION BY metric) AS mu, stddev_pop(x) FILTER (WHERE rn <= 14) OVER (PARTITION BY metric) AS sg FROM r),
    d AS (SELECT *, sum(CASE WHEN rn > 14 THEN x - mu - 0.5e0*sg ELSE 0 END) OVER w AS u, sum(CASE WHEN rn > 14 THEN mu - x - 0.5e0*sg ELSE 0 END) OVER w AS v FROM b WINDOW w AS (PARTITION BY metric ORDER BY h)),
    c AS (SELECT *, u - least(min(u) OVER w, 0) AS pos, v - least(min(v) OVER w, 0) AS neg FROM d WINDOW w AS (PARTITION BY metric ORDER BY h)),
    o AS (SELECT *, list(x) OVER (PARTITION BY metric ORDER BY h) AS xs, max(h) OVER () AS last_h FROM c),
    y AS (SELECT *, list_reduce(xs, lambda e, q: 0.2e0*q + 0.8e0*e) AS ew, 3*sg*sqrt(0.2e0/1.8e0*(1 - pow(0.8e0, 2*rn))) AS lim FROM o)
    SELECT metric, h AS hour_no, """ + R("pos", "cusum_pos", 5) + ", " + R("neg", "cusum_neg", 5) + ", " + R("ew", "ewma", 5) + """, CASE WHEN greatest(pos, neg) > 4*sg THEN 'RED' WHEN abs(ew - mu) > lim THEN 'YELLOW' ELSE 'OK' END AS level
    FROM y WHERE rn > 14 AND h*3600000000 < last_h*3600000000 - 259200000000"""))
def _(spark, d):
    """Hourly means (first stream) feed the chart state (second stream)."""
    hours = IN.tumbling(stream(spark, d), ["metric"], sums=["cents"]).select("metric", F.col("window_start").alias("ts"), (F.col("cents").cast("double") / F.col("n") / 100).alias("value"))
    staged = IN.run_available(hours, "slots")
    path = staged.inputFiles()[0].rsplit("/", 1)[0]
    chart = charts.control_chart(IN.file_stream(spark, path, schema="metric STRING, ts TIMESTAMP, value DOUBLE"), ["metric"])
    out = IN.run_available(chart, "chart")
    return out.select("metric", F.floor(F.col("at_us") / F.lit(3_600_000_000)).alias("hour_no"), r6("cusum_pos", 5).alias("cusum_pos"), r6("cusum_neg", 5).alias("cusum_neg"), r6("ewma", 5).alias("ewma"), "level")
