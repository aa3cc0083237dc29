"""Variability, information, fractality, recurrence and spectra."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import complexity as X, daily as D, joins as J, spectral as P
from ..sources import adapters as A
from .registry import R, register
from .stats import rounded

sql, r6 = A.sql, S.r6
EM = ["entity_id", "metric"]


@register("poincare", sql("ls", """p AS (SELECT *, lead(value) OVER (PARTITION BY entity_id, metric ORDER BY day) AS nx FROM ls),
    g AS (SELECT entity_id, metric, count(*) AS n, stddev_samp(nx - value)/sqrt(2) AS sd1, stddev_samp(nx + value)/sqrt(2) AS sd2, var_samp(value) AS v FROM p GROUP BY ALL)
    SELECT entity_id, metric, n, """ + ", ".join([R("sd1", "sd1"), R("sd2", "sd2"), R("sqrt(2*v - sd1*sd1)", "sd2_total"), R("log10(sd1*sd2)", "cvi"), R("sd2/sd1", "csi")]) + " FROM g"))
def _(spark, d):
    return rounded(X.poincare(A.line_signals(spark, d), "value", EM), [*EM, "n"], "sd1", "sd2", "sd2_total", "cvi", "csi")


@register("stress_index", sql("ls", """l AS (SELECT *, min(value) OVER (PARTITION BY entity_id, metric) AS lo FROM ls),
    b AS (SELECT entity_id, metric, floor((value - lo + 0.5e0)/0.5e0) AS bin, count(*) AS c, min(lo) AS lo, max(value) AS hi FROM l GROUP BY ALL),
    g AS (SELECT entity_id, metric, CAST(sum(c) AS BIGINT) AS n, max(c) AS top, arg_max(bin, (c, -bin)) AS mb, min(lo) AS lo, max(hi) AS hi FROM b GROUP BY ALL),
    m AS (SELECT *, lo - 0.5e0 + (mb + 0.5e0)*0.5e0 AS mode, CAST(top AS DOUBLE)/n*100 AS amo, hi - lo AS rng FROM g)
    SELECT entity_id, metric, n, """ + ", ".join([R("mode", "mode"), R("amo", "amo_pct"), R("amo/(2*mode*rng)*1000", "si")])
    + ", CASE WHEN amo/(2*mode*rng)*1000 < 150 THEN 'normal' WHEN amo/(2*mode*rng)*1000 < 500 THEN 'moderate_stress' WHEN amo/(2*mode*rng)*1000 < 1000 THEN 'high_stress' ELSE 'pathological' END AS level FROM m"))
def _(spark, d):
    g = X.stress_index(A.line_signals(spark, d), "value", EM)
    return g.select(*EM, "n", *[r6(c).alias(c) for c in ("mode", "amo_pct", "si")], "level")


@register("hjorth", sql("ls", """a AS (SELECT *, value - lag(value) OVER w AS d1 FROM ls WINDOW w AS (PARTITION BY entity_id, metric ORDER BY day)),
    b AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY entity_id, metric ORDER BY day) AS d2 FROM a),
    g AS (SELECT entity_id, metric, var_pop(value) AS v0, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM b GROUP BY ALL)
    SELECT entity_id, metric, """ + ", ".join([R("v0", "activity"), R("sqrt(v1/v0)", "mobility"), R("sqrt(v2/v1)/sqrt(v1/v0)", "complexity")]) + " FROM g"))
def _(spark, d):
    return rounded(X.hjorth(A.line_signals(spark, d), "value", EM), EM, "activity", "mobility", "complexity")


@register("night_variability", sql("ed", """r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, metric ORDER BY day) AS i FROM ed)
    SELECT entity_id, metric, count(*) AS n, """ + ", ".join([R("stddev_samp(value)/avg(value)*100", "cv_pct"), R("regr_slope(value, i)", "slope")])
    + ", CASE WHEN regr_slope(value, i) > 0 THEN 'improving' WHEN regr_slope(value, i) < 0 THEN 'declining' ELSE 'stable' END AS trend FROM r GROUP BY ALL HAVING count(*) >= 3"))
def _(spark, d):
    g = X.night_variability(A.event_daily(spark, d), "value", EM)
    return g.select(*EM, "n", r6("cv_pct").alias("cv_pct"), r6("slope").alias("slope"), "trend")


@register("mutual_info", sql("ls", """x AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM ls WINDOW w AS (PARTITION BY entity_id, metric)),
    b AS (SELECT entity_id, metric, least(floor((value-lo)/((hi-lo)/5)), 4) AS b, day >= DATE '1998-06-01' AS y, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY ALL),
    t AS (SELECT *, c/sum(c) OVER w * ln(c * sum(c) OVER w / (sum(c) OVER (PARTITION BY entity_id, metric, b) * sum(c) OVER (PARTITION BY entity_id, metric, y))) AS t FROM b WINDOW w AS (PARTITION BY entity_id, metric))
    SELECT entity_id, metric, """ + R("greatest(sum(t), 0)", "mi", 9) + " FROM t GROUP BY ALL"))
def _(spark, d):
    flag = F.col("day") >= F.lit("1998-06-01").cast("date")
    return rounded(X.mutual_information(A.line_signals(spark, d), "value", flag, EM), EM, "mi", digits=9)


def _te_sql(where: str = "", plain: bool = False) -> str:
    """Transfer entropies of the days that ``where`` leaves; ``plain`` without net flow."""
    ms = A.LINE_METRICS
    code = ", ".join("(" + " + ".join(f"({m} >= quantile_cont({m}, {q}) OVER w)::INT" for q in (.2, .4, .6, .8)) + f") AS q_{m}" for m in ms)
    past = ", ".join(f"lag(q_{m},1) OVER w + 5*lag(q_{m},2) OVER w + 25*lag(q_{m},3) OVER w AS p_{m}" for m in ms)
    pairs = " UNION ALL ".join(f"SELECT entity_id, '{x}' AS source, '{y}' AS target, q_{y} AS y, p_{y} AS yp, p_{x} AS xp FROM p WHERE p_{x} IS NOT NULL" for x in ms for y in ms if x != y)
    k = "entity_id, source, target"
    return f"""q AS (SELECT entity_id, day, {code} FROM ld {where} WINDOW w AS (PARTITION BY entity_id)),
    p AS (SELECT *, {past} FROM q WINDOW w AS (PARTITION BY entity_id ORDER BY day)),
    c AS (SELECT {k}, y, yp, xp, CAST(count(*) AS DOUBLE) AS c FROM ({pairs}) GROUP BY ALL),
    t AS (SELECT {k}, c/sum(c) OVER (PARTITION BY {k}) * log2(c * sum(c) OVER (PARTITION BY {k}, yp) / (sum(c) OVER (PARTITION BY {k}, yp, xp) * sum(c) OVER (PARTITION BY {k}, y, yp))) AS t FROM c),
    e AS (SELECT {k}, greatest(sum(t), 0) AS te FROM t GROUP BY ALL)
    """ + ("SELECT * FROM e" if plain else """SELECT a.entity_id, a.source, a.target, """ + R("a.te", "te") + ", " + R("a.te - b.te", "net") + " FROM e a JOIN e b ON a.entity_id = b.entity_id AND a.source = b.target AND a.target = b.source")


@register("transfer_entropy", sql("ld", _te_sql()))
def _(spark, d):
    te = X.transfer_entropy(A.line_daily(spark, d), A.LINE_METRICS, ["entity_id"])
    return rounded(X.net_flow(te, ["entity_id"]), ["entity_id", "source", "target"], "te", "net")


@register("transfer_change", sql("ld", f"""SELECT entity_id, source, target, {R("f.te", "te")}, {R("p.te", "te_pre")}, {R("f.te - p.te", "diff")}
    FROM (WITH {_te_sql(plain=True)}) f JOIN (WITH {_te_sql("WHERE day < DATE '1998-06-01'", plain=True)}) p USING (entity_id, source, target)"""))
def _(spark, d):
    """Transfer entropy of the whole series, of the pre-event part, and their difference."""
    line, keys = A.line_daily(spark, d), ["entity_id", "source", "target"]
    full = X.transfer_entropy(line, A.LINE_METRICS, ["entity_id"])
    pre = X.transfer_entropy(line.where(F.col("day") < F.lit("1998-06-01").cast("date")), A.LINE_METRICS, ["entity_id"])
    j = full.join(pre.withColumnRenamed("te", "te_pre"), keys)
    return rounded(j.withColumn("diff", F.col("te") - F.col("te_pre")), keys, "te", "te_pre", "diff")


@register("perm_entropy", sql("ls", """a AS (SELECT entity_id, metric, value AS a, lead(value,1) OVER w AS b, lead(value,2) OVER w AS c FROM ls WINDOW w AS (PARTITION BY entity_id, metric ORDER BY day)),
    g AS (SELECT entity_id, metric, (a>b)::INT*4 + (a>c)::INT*2 + (b>c)::INT AS k, CAST(count(*) AS DOUBLE) AS n FROM a WHERE c IS NOT NULL GROUP BY ALL),
    p AS (SELECT *, n/sum(n) OVER (PARTITION BY entity_id, metric) AS p FROM g)
    SELECT entity_id, metric, """ + R("-sum(p*log2(p))/log2(6)", "pe") + " FROM p GROUP BY ALL"))
def _(spark, d):
    return rounded(X.permutation_entropy(A.line_signals(spark, d), "value", EM), EM, "pe")


def _dfa_sql(lo: int, hi: int) -> str:
    return f"""x AS (SELECT *, value - avg(value) OVER (PARTITION BY entity_id, metric) AS x FROM ls),
    w AS (SELECT entity_id, metric, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY entity_id, metric) AS n, sum(x) OVER o AS w FROM x WINDOW o AS (PARTITION BY entity_id, metric ORDER BY day)),
    s AS (SELECT unnest(range({lo}, {hi})) AS s),
    b AS (SELECT DISTINCT entity_id, metric, s, k FROM (SELECT entity_id, metric, n, s, unnest(range(0, CAST(ceil((n - s) / CAST(s//2 AS DOUBLE)) AS BIGINT))) AS k FROM (SELECT DISTINCT entity_id, metric, n FROM w), s WHERE n >= 4*s)),
    e AS (SELECT b.entity_id, b.metric, b.s, b.k, b.k*(b.s//2) + j AS i FROM b, LATERAL (SELECT unnest(range(0, b.s)) AS j)),
    r AS (SELECT e.entity_id, e.metric, s, k, regr_syy(w.w, w.i) AS syy, regr_sxy(w.w, w.i) AS sxy, regr_sxx(w.w, w.i) AS sxx FROM e JOIN w ON w.entity_id = e.entity_id AND w.metric = e.metric AND w.i = e.i GROUP BY ALL),
    f AS (SELECT entity_id, metric, s, avg(sqrt(greatest(syy - sxy*sxy/sxx, 0)/s)) AS f FROM r GROUP BY ALL)
    SELECT entity_id, metric, count(*) AS n_scales, """ + R("regr_slope(ln(f), ln(s))", "alpha", 5) + " FROM f GROUP BY ALL"


@register("dfa", sql("ls", _dfa_sql(4, 17)))
def _(spark, d):
    return rounded(X.fluctuation(A.line_signals(spark, d), "value", EM, range(4, 17)), [*EM, "n_scales"], "alpha", digits=5)


@register("dfa_long", sql("ls", _dfa_sql(16, 65)))
def _(spark, d):
    return rounded(X.fluctuation(A.line_signals(spark, d), "value", EM, range(16, 65)), [*EM, "n_scales"], "alpha", digits=5)


#: One series for each entity and metric; twins carry both in one key.
SERIES = "x AS (SELECT entity_id || ':' || metric AS entity_id, row_number() OVER (PARTITION BY entity_id, metric ORDER BY day) AS i, value AS a FROM ls)"
BOTH = "split_part(entity_id, ':', 1) AS entity_id, split_part(entity_id, ':', 2) AS metric"


@register("sample_entropy", sql("ls", SERIES + """,
    t AS (SELECT *, 0.2e0*stddev_pop(a) OVER (PARTITION BY entity_id) AS r, lead(a,1) OVER w AS b, lead(a,2) OVER w AS c FROM x WINDOW w AS (PARTITION BY entity_id ORDER BY i)),
    p AS (SELECT s.entity_id, count(*) AS b, count(*) FILTER (WHERE abs(s.c-t.c) <= s.r) AS a FROM t s JOIN t ON s.entity_id = t.entity_id AND s.i <> t.i AND abs(s.a-t.a) <= s.r AND abs(s.b-t.b) <= s.r
      WHERE s.c IS NOT NULL AND t.c IS NOT NULL GROUP BY 1)
    SELECT """ + BOTH + ", a, b, " + R("-ln(CAST(a AS DOUBLE)/b)", "sampen") + " FROM p"))
def _(spark, d):
    return rounded(X.sample_entropy(A.line_signals(spark, d), "value", EM), [*EM, "a", "b"], "sampen")


@register("multiscale_entropy", sql("ls", SERIES + """, c AS (SELECT *, count(*) OVER (PARTITION BY entity_id) AS n FROM x),
    y AS (SELECT entity_id, s, (i - 1)//s AS i, avg(a) AS a, any_value(n//s) AS k FROM c, (SELECT unnest(range(1, 21)) AS s) WHERE i <= (n//s)*s AND n//s >= 30 GROUP BY entity_id, s, (i - 1)//s),
    t AS MATERIALIZED (SELECT *, 0.2e0*stddev_pop(a) OVER (PARTITION BY entity_id, s) AS r, lead(a,1) OVER w AS b, lead(a,2) OVER w AS c FROM y WINDOW w AS (PARTITION BY entity_id, s ORDER BY i)),
    p AS (SELECT u.entity_id, u.s, count(*) AS b, count(*) FILTER (WHERE abs(u.c-t.c) <= u.r) AS a FROM t u JOIN t ON u.entity_id = t.entity_id AND u.s = t.s AND u.i <> t.i AND abs(u.a-t.a) <= u.r AND abs(u.b-t.b) <= u.r
      WHERE u.c IS NOT NULL AND t.c IS NOT NULL GROUP BY ALL),
    e AS (SELECT entity_id, s, CASE WHEN a > 0 THEN -ln(CAST(a AS DOUBLE)/b) END AS e FROM p),
    g AS (SELECT entity_id, count(e) AS n_scales, avg(e) FILTER (s <= 5) AS lo, avg(e) FILTER (s > 10) AS hi FROM e GROUP BY 1)
    SELECT """ + BOTH + ", n_scales, " + R("lo", "low_mean") + ", " + R("hi", "high_mean") + """, CASE WHEN n_scales < 10 THEN 'insufficient_data' WHEN hi < 0.5 AND lo > 0.5 THEN 'neuropathic' WHEN lo < 0.3 THEN 'severely_reduced'
      WHEN hi > lo*0.8e0 THEN 'inflammatory' ELSE 'mixed' END AS pattern FROM g"""))
def _(spark, d):
    mse = X.sample_entropy(A.line_signals(spark, d), "value", EM, scales=range(1, 21))
    return rounded(X.multiscale_pattern(mse, EM), [*EM, "n_scales", "pattern"], "low_mean", "high_mean")


@register("rqa", sql("ls", SERIES + """,
    t AS MATERIALIZED (SELECT * FROM (SELECT *, 0.1e0*stddev_samp(a) OVER (PARTITION BY entity_id) AS r, lead(a,1) OVER w AS b, lead(a,2) OVER w AS c FROM x WINDOW w AS (PARTITION BY entity_id ORDER BY i)) WHERE c IS NOT NULL),
    p AS MATERIALIZED (SELECT s.entity_id, s.i, t.i AS j FROM t s JOIN t ON s.entity_id = t.entity_id AND abs(s.a-t.a) <= s.r AND abs(s.b-t.b) <= s.r AND abs(s.c-t.c) <= s.r),
    n AS (SELECT entity_id, count(*) AS m FROM t GROUP BY 1),
    rr AS (SELECT entity_id, count(*) FILTER (WHERE i <> j) AS rec FROM p GROUP BY 1),
    dg AS (SELECT entity_id, count(*) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY entity_id, j-i ORDER BY i) AS g FROM p WHERE j > i) GROUP BY entity_id, j-i, g HAVING count(*) >= 2),
    dl AS (SELECT entity_id, len, count(*) AS c, sum(count(*)) OVER (PARTITION BY entity_id) AS tot FROM dg GROUP BY entity_id, len),
    ds AS (SELECT entity_id, sum(len*c) AS det, -sum(c/CAST(tot AS DOUBLE)*log2(c/CAST(tot AS DOUBLE))) AS h FROM dl GROUP BY 1),
    vt AS (SELECT entity_id, sum(len) AS lam FROM (SELECT entity_id, count(*) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY entity_id, j ORDER BY i) AS g FROM p) GROUP BY entity_id, j, g HAVING count(*) >= 2) GROUP BY 1)
    SELECT """ + BOTH + ", m, rec AS recurrences, " + ", ".join([R("rec/(CAST(m AS DOUBLE)*m - m)", "rate"), R("coalesce(det, 0)/(rec/2.0e0)", "determinism"), R("coalesce(lam, 0)/CAST(rec AS DOUBLE)", "laminarity"), R("coalesce(h, 0)", "diagonal_entropy")])
    + " FROM n JOIN rr USING (entity_id) LEFT JOIN ds USING (entity_id) LEFT JOIN vt USING (entity_id)"))
def _(spark, d):
    return rounded(X.recurrence(A.line_signals(spark, d), "value", EM), [*EM, "m", "recurrences"], "rate", "determinism", "laminarity", "diagonal_entropy")


FREQS = P.linspace(0.001, 0.005, 500)


def _lomb_sql() -> str:
    grid = "[" + ", ".join(f"{f!r}e0" if "e" not in repr(f) else repr(f) for f in FREQS) + "]"
    return f"""c AS (SELECT entity_id, value - avg(value) OVER w AS y, (epoch_us(ts) - min(epoch_us(ts)) OVER w)/3600000000.0e0 AS t, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY entity_id)),
    f AS (SELECT entity_id, y, freq, cos({2 * math.pi!r}e0*freq*t) AS c, sin({2 * math.pi!r}e0*freq*t) AS s FROM c, (SELECT unnest({grid}) AS freq) WHERE n >= 20),
    g AS (SELECT entity_id, freq, sum(y*c) AS yc, sum(y*s) AS ys, sum(c*c) AS cc, sum(s*s) AS ss, sum(c*s) AS cs, sum(y*y) AS yy FROM f GROUP BY ALL),
    r AS (SELECT *, cos(atan2(2*cs, cc-ss)/2) AS u, sin(atan2(2*cs, cc-ss)/2) AS v FROM g),
    p AS (SELECT entity_id, freq, (pow(u*yc+v*ys,2)/(u*u*cc+2*u*v*cs+v*v*ss) + pow(u*ys-v*yc,2)/(u*u*ss-2*u*v*cs+v*v*cc))/yy AS power FROM r)"""


def lomb(spark, d):
    start = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    hours = (S.epoch_us("ts") - start) / F.lit(3_600_000_000.0)
    return P.lomb_scargle(A.samples(spark, d), "value", hours, ["entity_id"], FREQS)


@register("lomb_scargle", sql("ev", _lomb_sql() + " SELECT entity_id, " + R("freq", "freq", 9) + ", " + R("power", "power", 5) + " FROM p"))
def _(spark, d):
    return lomb(spark, d).select("entity_id", r6("freq", 9).alias("freq"), r6("power", 5).alias("power"))


@register("band_shares", sql("ev", _lomb_sql() + """, bd AS (SELECT *, CASE WHEN freq < 0.002 THEN 'vlf' WHEN freq < 0.0035 THEN 'lf' ELSE 'hf' END AS band FROM p),
    ar AS (SELECT entity_id, band, (power + lag(power) OVER w)/2*(freq - lag(freq) OVER w) AS a FROM bd WINDOW w AS (PARTITION BY entity_id, band ORDER BY freq)),
    sm AS (SELECT entity_id, sum(a) FILTER (WHERE band='vlf') AS v, sum(a) FILTER (WHERE band='lf') AS l, sum(a) FILTER (WHERE band='hf') AS h FROM ar GROUP BY 1)
    SELECT entity_id, """ + ", ".join([R("v/(v+l+h)*100", "vlf_pct", 4), R("l/(v+l+h)*100", "lf_pct", 4), R("h/(v+l+h)*100", "hf_pct", 4), R("l/h", "lf_hf", 4)]) + " FROM sm"))
def _(spark, d):
    return rounded(P.band_shares(lomb(spark, d), ["entity_id"]), ["entity_id"], "vlf_pct", "lf_pct", "hf_pct", "lf_hf", digits=4)


NIGHT = ["entity_id", "week_no"]
PER = f"""y AS (SELECT entity_id, week_no, epoch_index AS i, (CASE phase WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END) - avg(CASE phase WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END) OVER w AS y,
      max(epoch_index) OVER w + 1 AS n, count(*) OVER w AS c FROM ep WINDOW w AS (PARTITION BY entity_id, week_no)),
    k AS (SELECT *, unnest(range(CAST(greatest(ceil(n*5/180.0e0), 1) AS BIGINT), CAST(least(floor(n*5/30.0e0), n//2) AS BIGINT) + 1)) AS k FROM y WHERE c >= 10),
    g AS (SELECT entity_id, week_no, n, k, sum(y*cos({2 * math.pi!r}e0*((k*i) % n)/n)) AS re, sum(y*sin({2 * math.pi!r}e0*((k*i) % n)/n)) AS im FROM k GROUP BY ALL),
    pw AS (SELECT entity_id, week_no, n, k, n*5.0e0/k AS period_min, CASE WHEN 2*k = n THEN 1 ELSE 2 END*(re*re+im*im)*300/n AS power FROM g)"""
PEAKS = """t AS (SELECT *, row_number() OVER (PARTITION BY entity_id, week_no ORDER BY round(power, 6) DESC, k) AS place FROM pw WHERE power > 0)"""


def depth_spectrum(spark, d):
    """Every week of every entity on its own grid of 5-minute slots."""
    return P.periodogram(A.epochs(spark, d).withColumn("depth", S.depth_signal("phase")), "depth", NIGHT, "epoch_index")


@register("periodogram", sql("ep", PER + " SELECT entity_id, week_no, k, " + R("period_min", "period_min") + ", " + R("power", "power", 4) + " FROM pw"))
def _(spark, d):
    return depth_spectrum(spark, d).select(*NIGHT, "k", r6("period_min").alias("period_min"), r6("power", 4).alias("power"))


@register("ultradian_peaks", sql("ep", PER + ", " + PEAKS + " SELECT entity_id, week_no, k, CAST(place AS INTEGER) AS place FROM t WHERE place <= 3"))
def _(spark, d):
    return P.top_peaks(depth_spectrum(spark, d), NIGHT).select(*NIGHT, "k", "place")


@register("peak_summary", sql("ep", PER + ", " + PEAKS + """, b AS (SELECT entity_id, CAST(round_even(round(period_min, 1)/5, 0)*5 AS INTEGER) AS period_bin, avg(power) AS mean_power, count(*) AS n FROM t WHERE place <= 3 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(mean_power, 6) DESC, period_bin) AS place FROM b)
    SELECT entity_id, period_bin, """ + R("mean_power", "mean_power", 4) + ", n FROM r WHERE place <= 5"))
def _(spark, d):
    """Strongest periods of each entity over its weeks."""
    s = P.peak_summary(P.top_peaks(depth_spectrum(spark, d), NIGHT), ["entity_id"])
    return s.select("entity_id", "period_bin", r6("mean_power", 4).alias("mean_power"), "n")


@register("spectral_entropy", sql("ep", PER + """, p AS (SELECT *, power/sum(power) OVER (PARTITION BY entity_id, week_no) AS p FROM pw WHERE power > 1e-9)
    SELECT entity_id, week_no, count(*) AS n_bins, """ + R("-sum(p*log2(p))/log2(count(*))", "spectral_entropy") + " FROM p GROUP BY ALL HAVING count(*) > 1"))
def _(spark, d):
    return rounded(P.spectral_entropy(depth_spectrum(spark, d).where("power > 1e-9"), NIGHT), [*NIGHT, "n_bins"], "spectral_entropy")


@register("lag_density", sql("ls", """p AS (SELECT entity_id, metric, value AS x, lead(value) OVER (PARTITION BY entity_id, metric ORDER BY day) AS y FROM ls)
    SELECT entity_id, metric, CAST(floor(x/2.5e0) AS BIGINT) AS x_bin, CAST(floor(y/2.5e0) AS BIGINT) AS y_bin, count(*) AS n FROM p WHERE y IS NOT NULL GROUP BY ALL"""))
def _(spark, d):
    p = J.lag_pairs_rows(A.line_signals(spark, d), "value", "value", EM, 1)
    return D.density_2d(p, EM, "x", "y", 2.5)
