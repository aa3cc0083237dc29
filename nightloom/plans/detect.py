"""Anomaly and changepoint plans."""

from __future__ import annotations

import math
from datetime import date
from functools import reduce

from pyspark.sql import Window, functions as F

from ..functions import scalar as S
from ..operators import anomaly as AN, changepoint as CP, density as DN, forest as FR, joins as J, spc, windows as W
from ..sources import adapters as A
from .registry import R, register
from .series import SPC_BASE
from .stats import rounded

sql, r6 = A.sql, S.r6
EM = ["entity_id", "metric"]
LM = A.LINE_METRICS
CUT = date(1998, 6, 1)

ZW = "zw AS (SELECT *, " + ", ".join(f"({m} - avg({m}) OVER w)/stddev_samp({m}) OVER w AS z_{m}" for m in LM) + " FROM ld WINDOW w AS (PARTITION BY entity_id))"
N_EXT = "(" + " + ".join(f"(abs(z_{m}) > 2)::INT" for m in LM) + ")"
MEAN_Z = "((" + " + ".join(f"abs(z_{m})" for m in LM) + ")/4)"
PV = "pv AS (SELECT entity_id, day, CAST(" + " + ".join(f"({m} < quantile_cont({m}, 0.05) OVER w OR {m} > quantile_cont({m}, 0.95) OVER w)::INT" for m in LM) + " AS INTEGER) AS n_outside FROM ld WINDOW w AS (PARTITION BY entity_id))"
ANOM = f"an AS (SELECT *, {MEAN_Z} AS score FROM zw WHERE {N_EXT} >= 2)"


def line_z(spark, d):
    return AN.with_z(A.line_daily(spark, d), LM, ["entity_id"])


def marked(spark, d):
    """Days with at least two metrics beyond two sd, scored by mean |z|."""
    v = AN.z_vote(line_z(spark, d), LM)
    return v.where("n_extreme >= 2").withColumn("score", F.col("mean_abs_z"))


@register("z_vote", sql("ld", ZW + f" SELECT entity_id, day, CAST({N_EXT} AS INTEGER) AS n_extreme, " + R(MEAN_Z, "mean_abs_z") + f", {N_EXT} >= 3 OR {MEAN_Z} > 2 AS z_anomaly FROM zw"))
def _(spark, d):
    return AN.z_vote(line_z(spark, d), LM).select("entity_id", "day", "n_extreme", r6("mean_abs_z").alias("mean_abs_z"), "z_anomaly")


@register("pct_vote", sql("ld", PV + " SELECT entity_id, day, n_outside, n_outside >= 3 AS pct_anomaly FROM pv"))
def _(spark, d):
    return AN.percentile_vote(A.line_daily(spark, d), LM, ["entity_id"]).select("entity_id", "day", "n_outside", "pct_anomaly")


FOREST = FR.forest_sql("ld", LM)


@register("isolation_forest", sql("ld", FOREST + " SELECT entity_id, day, " + R("raw_score", "raw_score") + ", " + R("forest_score", "forest_score") + ", forest_anomaly FROM fo"))
def _(spark, d):
    f = FR.isolation_forest(A.line_daily(spark, d), LM)
    return f.select("entity_id", "day", r6("raw_score").alias("raw_score"), r6("forest_score").alias("forest_score"), "forest_anomaly")


def voted(spark, d):
    """z vote, forest and percentile vote of every day."""
    line = A.line_daily(spark, d)
    v = AN.percentile_vote(AN.z_vote(line_z(spark, d), LM), LM, ["entity_id"])
    f = FR.isolation_forest(line, LM).drop("raw_score")
    return AN.vote_ensemble(v.join(f, ["entity_id", "day"]), 4)


VOTED = ZW + ", " + PV + ", " + FOREST + f""", vt AS (SELECT entity_id, day, n_outside, {N_EXT} >= 3 OR {MEAN_Z} > 2 AS za, {MEAN_Z} AS mz, n_outside >= 3 AS pa, forest_anomaly AS fa, forest_score AS fs
    FROM zw JOIN pv USING (entity_id, day) JOIN fo USING (entity_id, day))"""


@register("vote_ensemble", sql("ld", VOTED + " SELECT entity_id, day, CAST(za::INT + pa::INT + fa::INT AS INTEGER) AS votes, " + R("0.35e0*mz + 0.40e0*fs + 0.25e0*n_outside/4", "score") + ", za::INT + pa::INT + fa::INT >= 2 AS anomaly FROM vt"))
def _(spark, d):
    return voted(spark, d).select("entity_id", "day", "votes", r6("score").alias("score"), "anomaly")


@register("full_vote_ensemble", sql("ld", VOTED + " SELECT entity_id, day, za AS z_anomaly, fa AS forest_anomaly, pa AS pct_anomaly, " + R("fs", "forest_score") + " FROM vt WHERE za::INT + pa::INT + fa::INT >= 2"))
def _(spark, d):
    """The days that two of the three methods agree on, with each method's vote."""
    return voted(spark, d).where("anomaly").select("entity_id", "day", "z_anomaly", "forest_anomaly", "pct_anomaly", r6("forest_score").alias("forest_score"))


WINDOWS = (3, 5, 7)


def _profile_sql(m: int) -> str:
    """Profile of window m: subsequences as lists, zone of ceil(m / 4) on both sides."""
    dev = "list_transform(v, lambda e: (e - mu)/(CASE WHEN sd < 1e-12 THEN 1 ELSE sd END))"
    return f"""t{m} AS (SELECT entity_id, i, list(a) OVER (PARTITION BY entity_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING) AS v FROM x),
    u{m} AS (SELECT entity_id, i, v, list_avg(v) AS mu FROM t{m} WHERE len(v) = {m}),
    s{m} AS (SELECT *, sqrt(list_sum(list_transform(v, lambda e: (e - mu)*(e - mu)))/{m}) AS sd FROM u{m}),
    y{m} AS (SELECT entity_id, i, sd < 1e-12 AS flat, CAST({dev} AS DOUBLE[{m}]) AS z FROM s{m}),
    p{m} AS (SELECT a.entity_id, a.i, min(CASE WHEN a.flat <> b.flat THEN {m}.0e0 WHEN a.flat THEN 0.0e0 ELSE greatest(2*({m} - array_inner_product(a.z, b.z)), 0) END) AS d2
      FROM y{m} a JOIN y{m} b ON a.entity_id = b.entity_id AND abs(a.i - b.i) > {math.ceil(m / 4)} GROUP BY ALL)"""


PROFILE = "x AS (SELECT entity_id || ':' || metric AS entity_id, day, row_number() OVER (PARTITION BY entity_id, metric ORDER BY day) - 1 AS i, value AS a FROM ls), " + ", ".join(_profile_sql(m) for m in WINDOWS) \
    + ", pr AS (" + " UNION ALL ".join(f"SELECT {m} AS width, split_part(entity_id, ':', 1) AS entity_id, split_part(entity_id, ':', 2) AS metric, CAST(i AS INTEGER) AS pos, round(sqrt(d2), 4) AS distance FROM p{m}" for m in WINDOWS) + ")"


def profiles(spark, d):
    line = A.line_signals(spark, d)
    parts = [AN.matrix_profile(line, "value", EM, m).select(F.lit(m).alias("width"), *EM, "pos", r6("distance", 4).alias("distance")) for m in WINDOWS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("matrix_profile", sql("ls", PROFILE + " SELECT width, entity_id, metric, pos, " + R("distance", "distance", 4) + " FROM pr"))
def _(spark, d):
    return profiles(spark, d)


@register("top_discords", sql("ls", PROFILE + ", k AS (SELECT *, row_number() OVER (PARTITION BY width, entity_id, metric ORDER BY distance DESC, pos) AS rank FROM pr) SELECT width, entity_id, metric, pos, " + R("distance", "distance", 4)
    + ", CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5"))
def _(spark, d):
    """The five subsequences of each window farthest from their nearest neighbour."""
    w = Window.partitionBy("width", *EM).orderBy(F.desc("distance"), "pos")
    return profiles(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 5")


@register("window_recon", sql("ld", "wr AS (SELECT entity_id, day, row_number() OVER (PARTITION BY entity_id ORDER BY day) AS i FROM ld) SELECT entity_id, day, day < DATE '1998-06-01' AS trained, 'ok' AS status, true AS measured FROM wr WHERE i >= 7"))
def _(spark, d):
    """Which windows are training ones and measured; their errors are checked by window_identities."""
    w = AN.window_reconstruction(A.line_daily(spark, d), LM, F.col("day") < F.lit(CUT))
    return w.select("entity_id", "day", "trained", "status", (F.col("error") >= 0).alias("measured"))


CELLS = ", ".join(f"lag({m}, {k}) OVER w AS {m}_{k}" for k in range(7) for m in LM)
CELL_NAMES = [f"{m}_{k}" for k in range(7) for m in LM]


@register("window_identities", sql("ld", f"wn AS (SELECT entity_id, day, {CELLS} FROM ld WINDOW w AS (PARTITION BY entity_id ORDER BY day)), wt AS (SELECT * FROM wn WHERE day < DATE '1998-06-01' AND {LM[0]}_6 IS NOT NULL), "
    "cc AS (SELECT entity_id, count(*) AS n_train, " + " + ".join(f"pow(corr({a}, {b}), 2)" for x, a in enumerate(CELL_NAMES) for b in CELL_NAMES[x + 1:]) + " AS half FROM wt GROUP BY entity_id) "
    f"SELECT entity_id, n_train, {len(CELL_NAMES)}.0e0 AS trace, " + R(f"2*half + {len(CELL_NAMES)}", "squares", 5) + f", {len(CELL_NAMES)}.0e0 AS kept_and_left FROM cc"))
def _(spark, d):
    """The variances of all axes add up to the number of cells, their squares to those of all correlations; and what the
    leading axes keep and the mean training error leaves is the whole."""
    line, train = A.line_daily(spark, d), F.col("day") < F.lit(CUT)
    basis = AN.window_basis(AN.windows_of(line, LM, train, ["entity_id"], "day", 7).where("trained"), ["entity_id"])
    left = AN.window_reconstruction(line, LM, train).where("trained").groupBy("entity_id").agg(F.avg("error").alias("left"))
    total = lambda c, f=lambda x: x: F.aggregate(c, F.lit(0.0), lambda t, x: t + f(x))
    j = basis.join(left, "entity_id")
    kept = total(F.slice("variances", 1, 4)) + F.col("left") * F.size("variances")
    return j.select("entity_id", F.col("n").alias("n_train"), r6(total("variances")).alias("trace"), r6(total("variances", lambda x: x * x), 5).alias("squares"), r6(kept).alias("kept_and_left"))


@register("night_features", sql("ev", "SELECT entity_id, day, count(*) AS length, " + ", ".join([R("sum(value)", "sum"), R("median(value)", "median"), R("avg(value)", "mean"), R("stddev_pop(value)", "sd", 5), R("sqrt(avg(value*value))", "rms"), R("max(value)", "maximum"), R("min(value)", "minimum")]) + " FROM ev GROUP BY entity_id, day HAVING count(*) >= 2"))
def _(spark, d):
    f = AN.night_features(A.samples(spark, d), ["entity_id", "day"])
    return f.select("entity_id", "day", "length", *[r6(c, 5 if c == "sd" else 6).alias(c) for c in ("sum", "median", "mean", "sd", "rms", "maximum", "minimum")])


def density_sql(source: str, cols: list[str], eps: float, min_samples: int, scale: bool = False) -> str:
    """Density clusters of the rows of ``source`` by all pairs and a recursive walk over core links; ends in ``dn``."""
    val = {c: f"coalesce(CASE WHEN isnan({c}) THEN 0 ELSE {c} END, 0)" for c in cols}
    if scale:
        val = {c: f"({v} - avg({v}) OVER g)/(CASE WHEN stddev_pop({v}) OVER g > 1e-12 THEN stddev_pop({v}) OVER g ELSE 1 END)" for c, v in val.items()}
    diff = lambda a, b: "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c})*({a}.{c} - {b}.{c})" for c in cols) + ")"
    sq = lambda a: " + ".join(f"{a}.{c}*{a}.{c}" for c in cols)
    means = ", ".join(f"avg({c}) AS {c}" for c in cols)
    return f"""dp AS MATERIALIZED (SELECT entity_id, day, {", ".join(f"{v} AS {c}" for c, v in val.items())} FROM {source} WINDOW g AS (PARTITION BY entity_id)),
    nb AS MATERIALIZED (SELECT a.entity_id, a.day AS u, b.day AS v FROM dp a JOIN dp b USING (entity_id) WHERE {diff("a", "b")} <= {eps}),
    co AS MATERIALIZED (SELECT entity_id, u FROM nb GROUP BY ALL HAVING count(*) >= {min_samples}),
    ln AS MATERIALIZED (SELECT entity_id, u, v FROM nb SEMI JOIN co USING (entity_id, u) WHERE (entity_id, v) IN (SELECT entity_id, u FROM co)),
    wk(entity_id, u, c) AS (SELECT entity_id, u, u FROM co UNION SELECT ln.entity_id, ln.u, wk.c FROM wk JOIN ln ON ln.entity_id = wk.entity_id AND ln.v = wk.u),
    lb AS MATERIALIZED (SELECT entity_id, u, min(c) AS c FROM wk GROUP BY ALL),
    nm AS (SELECT entity_id, c, dense_rank() OVER (PARTITION BY entity_id ORDER BY c) - 1 AS k FROM (SELECT DISTINCT entity_id, c FROM lb)),
    pl AS (SELECT entity_id, u, min(c) AS c FROM (SELECT * FROM lb UNION ALL SELECT nb.entity_id, nb.u, lb.c FROM nb JOIN lb ON lb.entity_id = nb.entity_id AND lb.u = nb.v
        WHERE (nb.entity_id, nb.u) NOT IN (SELECT entity_id, u FROM co)) GROUP BY ALL),
    mb AS MATERIALIZED (SELECT dp.*, coalesce(k, -1) AS cluster FROM dp LEFT JOIN pl ON pl.entity_id = dp.entity_id AND pl.u = dp.day LEFT JOIN nm ON nm.entity_id = pl.entity_id AND nm.c = pl.c),
    ce AS MATERIALIZED (SELECT entity_id, cluster, count(*) AS n, {means} FROM mb WHERE cluster >= 0 GROUP BY ALL),
    ov AS (SELECT entity_id, {means} FROM mb GROUP BY entity_id),
    ds AS (SELECT m.entity_id, m.day, coalesce(min({diff("m", "c")}) FILTER (m.cluster < 0 OR m.cluster = c.cluster), any_value({diff("m", "o")})) AS distance
        FROM mb m JOIN ov o USING (entity_id) LEFT JOIN ce c ON c.entity_id = m.entity_id GROUP BY m.entity_id, m.day),
    ap AS (SELECT a.entity_id, a.day, a.cluster = b.cluster AS own, b.cluster, count(*) AS n, sum(pow({diff("a", "b")}, 2)) AS s
        FROM mb a JOIN mb b USING (entity_id) WHERE a.cluster >= 0 AND b.cluster >= 0 GROUP BY a.entity_id, a.day, a.cluster, b.cluster),
    si AS (SELECT entity_id, day, max(s/(n - 1)) FILTER (own AND n > 1) AS i, min(s/n) FILTER (NOT own) AS o FROM ap GROUP BY ALL),
    sl AS (SELECT entity_id, avg(CASE WHEN i IS NULL THEN 0 WHEN greatest(i, o) > 0 THEN (o - i)/greatest(i, o) ELSE 0 END) AS silhouette FROM si WHERE o IS NOT NULL GROUP BY 1),
    dn AS (SELECT m.entity_id, m.day, CAST(m.cluster AS INTEGER) AS cluster, distance, silhouette FROM mb m JOIN ds USING (entity_id, day) LEFT JOIN sl USING (entity_id))"""


DENSE = " SELECT entity_id, day, cluster, " + R("distance", "distance") + ", " + R("silhouette", "silhouette") + " FROM dn"
ZS = [AN.zcol(m) for m in LM]
NIGHT = ["sum", "median", "mean", "length", "sd", "variance", "rms", "maximum", "minimum"]
NIGHT_SQL = """nf AS MATERIALIZED (SELECT entity_id, day, count(*) AS length, sum(value) AS sum, median(value) AS median, avg(value) AS mean, stddev_pop(value) AS sd,
    var_pop(value) AS variance, sqrt(avg(value*value)) AS rms, max(value) AS maximum, min(value) AS minimum FROM ev GROUP BY entity_id, day HAVING count(*) >= 2)"""


@register("dbscan", sql("ld", ZW + ", " + ANOM + ", " + density_sql("an", ZS, 1.5, 3) + DENSE, recursive=True))
def _(spark, d):
    return DN.dbscan(marked(spark, d), ZS, eps=1.5, min_samples=3).select("entity_id", "day", "cluster", r6("distance").alias("distance"), r6("silhouette").alias("silhouette"))


def night_clusters(spark, d):
    f = AN.night_features(A.samples(spark, d), ["entity_id", "day"])
    return DN.dbscan(f, NIGHT, eps=3.0, min_samples=3, scale=True)


@register("feature_dbscan", sql("ev", NIGHT_SQL + ", " + density_sql("nf", NIGHT, 3.0, 3, scale=True) + DENSE, recursive=True))
def _(spark, d):
    return night_clusters(spark, d).select("entity_id", "day", "cluster", r6("distance").alias("distance"), r6("silhouette").alias("silhouette"))


@register("cluster_profiles", sql("ld", ZW + ", " + ANOM + ", " + density_sql("an", ZS, 1.5, 3) + ", pf AS (SELECT entity_id, cluster, n, " + ", ".join(ZS) + ", unnest(["
    + ", ".join(f"{{'s': abs({z}), 'c': '{z}'}}" for z in ZS) + "]) AS lead FROM ce) SELECT entity_id, CAST(cluster AS INTEGER) AS cluster, n, " + ", ".join(R(f"any_value({z})", z) for z in ZS) + ", max(lead).c AS leading FROM pf GROUP BY entity_id, cluster, n", recursive=True))
def _(spark, d):
    m = marked(spark, d)
    p = AN.cluster_profiles(DN.dbscan(m, ZS, eps=1.5, min_samples=3), m, ZS)
    return p.select("entity_id", "cluster", "n", *[r6(z).alias(z) for z in ZS], "leading")


@register("principal_axes", sql("ld", ZW + ", " + ANOM + ", cv AS (" + " UNION ALL ".join(f"SELECT entity_id, '{a}' AS metric_a, '{b}' AS metric_b, covar_samp({a}, {b}) AS cov FROM an GROUP BY entity_id HAVING count(*) > 1" for a in ZS for b in ZS)
    + ") SELECT entity_id, metric_a, metric_b, " + R("cov", "cov") + " FROM cv"))
def _(spark, d):
    """The covariance that all axes and their variances give back."""
    axes = AN.principal_axes(marked(spark, d), ZS, k=len(ZS))
    side = lambda s: axes.select("entity_id", "axis", F.col("metric").alias(f"metric_{s}"), F.col("loading").alias(s), "variance" if s == "a" else F.lit(1).alias("_"))
    j = side("a").join(side("b"), ["entity_id", "axis"])
    g = j.groupBy("entity_id", "metric_a", "metric_b").agg(F.sum(F.col("variance") * F.col("a") * F.col("b")).alias("cov"))
    return rounded(g, ["entity_id", "metric_a", "metric_b"], "cov")


@register("fingerprint", sql("ld", ZW + ", " + ANOM + ", f AS (" + " UNION ALL ".join(f"SELECT entity_id, '{m}' AS metric, count(*) AS n_days, avg(z_{m}) AS mz, avg(abs(z_{m})) AS ma FROM an GROUP BY entity_id" for m in LM)
    + ") SELECT entity_id, metric, n_days, " + R("mz", "mean_z") + ", " + R("ma", "mean_abs_z") + ", CAST(rank() OVER (PARTITION BY entity_id ORDER BY round(ma, 9) DESC) AS INTEGER) AS rank FROM f"))
def _(spark, d):
    return AN.fingerprint(marked(spark, d), LM).select("entity_id", "metric", "n_days", r6("mean_z").alias("mean_z"), r6("mean_abs_z").alias("mean_abs_z"), "rank")


@register("fingerprint_cosine", sql("ld", ZW + ", " + ANOM + ", f AS (" + " UNION ALL ".join(f"SELECT entity_id, '{m}' AS metric, avg(z_{m}) AS z FROM an GROUP BY entity_id" for m in LM)
    + ") SELECT a.entity_id AS left_id, b.entity_id AS right_id, " + R("sum(a.z*b.z)/sqrt(sum(a.z*a.z)*sum(b.z*b.z))", "cosine") + " FROM f a JOIN f b USING (metric) WHERE (a.entity_id, b.entity_id) IN (('A','R'), ('A','N'), ('N','R')) GROUP BY ALL"))
def _(spark, d):
    pairs = spark.createDataFrame([("A", "R"), ("A", "N"), ("N", "R")], "left_id STRING, right_id STRING")
    return AN.cosine(AN.fingerprint(marked(spark, d), LM), pairs).select("left_id", "right_id", r6("cosine").alias("cosine"))


@register("co_occurrence", sql("ld", ZW + ", " + ANOM + ", p AS (" + " UNION ALL ".join(
    f"SELECT entity_id, '{a}' AS metric_a, '{b}' AS metric_b, count(*) AS n, count(*) FILTER (WHERE abs(z_{a}) > 1.5 AND abs(z_{b}) > 1.5) AS n_both FROM an GROUP BY entity_id" for i, a in enumerate(LM) for b in LM[i + 1:])
    + ") SELECT entity_id, metric_a, metric_b, n_both, " + R("n_both/CAST(n AS DOUBLE)", "share") + " FROM p"))
def _(spark, d):
    return AN.co_occurrence(marked(spark, d), LM).select("entity_id", "metric_a", "metric_b", "n_both", r6("share").alias("share"))


@register("gap_gini", sql("ld", ZW + ", " + ANOM + """, g AS (SELECT entity_id, date_diff('day', lag(day) OVER (PARTITION BY entity_id ORDER BY day), day) AS gap FROM an),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY gap) AS i FROM g WHERE gap IS NOT NULL)
    SELECT entity_id, count(*) AS n_gaps, """ + R("(2*sum(i*gap) - (count(*)+1)*sum(gap))/(count(*)*CAST(sum(gap) AS DOUBLE))", "gini") + " FROM r GROUP BY 1"))
def _(spark, d):
    return rounded(AN.gap_gini(marked(spark, d)), ["entity_id", "n_gaps"], "gini")


@register("top_anomalies", sql("ld", ZW + ", " + ANOM + """, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(score, 9) DESC, day) AS place FROM an),
    l AS (SELECT * FROM r WHERE place <= 10), u AS (""" + " UNION ALL ".join(f"SELECT entity_id, day, place, '{m}' AS metric, abs(z_{m}) AS s FROM l" for m in LM)
    + "), k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, day ORDER BY s DESC, metric DESC) AS i FROM u) SELECT entity_id, day, CAST(place AS INTEGER) AS place, string_agg(metric, ',' ORDER BY i) AS top_metrics FROM k WHERE i <= 3 GROUP BY ALL"))
def _(spark, d):
    t = AN.top_anomalies(marked(spark, d), LM)
    return t.select("entity_id", "day", "place", F.concat_ws(",", F.transform("top_metrics", lambda x: x["metric"])).alias("top_metrics"))


@register("level_outliers", sql("ls", "SELECT entity_id, metric, day FROM (SELECT *, avg(value) OVER w + 2*stddev_samp(value) OVER w AS lim FROM ls WINDOW w AS (PARTITION BY entity_id, metric)) WHERE value > lim"))
def _(spark, d):
    return AN.level_outliers(A.line_signals(spark, d), "value", EM).select(*EM, "day")


@register("deviation_outliers", sql("ls", "x AS (SELECT entity_id, metric, day, value - avg(value) OVER (PARTITION BY metric) AS v FROM ls), y AS (SELECT *, avg(v) OVER w AS m, stddev_samp(v) OVER w AS s FROM x WINDOW w AS (PARTITION BY entity_id, metric)) SELECT entity_id, metric, day, " + R("(v-m)/s", "z") + " FROM y WHERE abs(v) > 2*s"))
def _(spark, d):
    """Deviations of every metric from its mean over all entities."""
    sig = A.line_signals(spark, d)
    x = sig.join(sig.groupBy("metric").agg(F.avg("value").alias("_m")), "metric").withColumn("v", F.col("value") - F.col("_m"))
    return AN.deviation_outliers(x, "v", EM).select(*EM, "day", r6("z").alias("z"))


@register("known_event_check", sql("ld", "e AS (SELECT entity_id, DATE '1998-06-01' AS day FROM ld GROUP BY 1), n AS (SELECT e.entity_id, e.day, arg_min(l.day, (abs(date_diff('day', e.day, l.day)), date_diff('day', e.day, l.day))) AS other_day, arg_min(l.qty, (abs(date_diff('day', e.day, l.day)), date_diff('day', e.day, l.day))) AS qty FROM e JOIN ld l ON l.entity_id = e.entity_id AND abs(date_diff('day', e.day, l.day)) <= 1 GROUP BY ALL) SELECT entity_id, other_day, abs(qty - 25) <= 5 AS confirmed FROM n"))
def _(spark, d):
    line = A.line_daily(spark, d)
    ev = line.select("entity_id").distinct().withColumn("event_date", F.lit(CUT)).withColumn("expected", F.lit(25.0))
    return AN.known_event_check(line, ev, "qty", ["entity_id"], 1, 5.0).select("entity_id", "other_day", "confirmed")


METHOD_SQL = FOREST + ", " + PROFILE.replace(", pr AS (", ", unused AS (") + ", mp AS (" + " UNION ALL ".join(
    f"""SELECT split_part(p.entity_id, ':', 1) AS entity_id, x.day, CASE WHEN max(sqrt(d2)) OVER k > min(sqrt(d2)) OVER k THEN (sqrt(d2) - min(sqrt(d2)) OVER k)/(max(sqrt(d2)) OVER k - min(sqrt(d2)) OVER k) ELSE 0 END AS score
      FROM p{m} p JOIN x ON x.entity_id = p.entity_id AND x.i = p.i WINDOW k AS (PARTITION BY p.entity_id)""" for m in WINDOWS
) + """), sc AS (SELECT entity_id, day, 'spc' AS method, round(max(least(abs((value-mu)/sigma)/3, 1.5)), 5) AS score FROM sp GROUP BY ALL
    UNION ALL SELECT entity_id, day, 'matrix_profile', round(score, 5) FROM mp UNION ALL SELECT entity_id, day, 'isolation_forest', round(forest_score, 5) FROM fo)"""


def profile_scores(spark, d):
    """Discord score of every day, window and metric."""
    sig = A.line_signals(spark, d)
    parts = [AN.matrix_profile(sig, "value", EM, m).select("entity_id", "day", "score", F.lit("matrix_profile").alias("method")) for m in WINDOWS]
    return reduce(lambda a, b: a.unionByName(b), parts)


def method_scores(spark, d):
    """Scores of the control charts, the discords and the forest."""
    s = spc.daily_score(spc.shewhart(A.line_signals(spark, d), "value", EM)).withColumn("method", F.lit("spc"))
    forest = FR.isolation_forest(A.line_daily(spark, d), LM).select("entity_id", "day", F.col("forest_score").alias("score"), F.lit("isolation_forest").alias("method"))
    return s.unionByName(profile_scores(spark, d)).unionByName(forest).withColumn("score", F.round("score", 5))


@register("method_ensemble", sql("ls", SPC_BASE + ", " + METHOD_SQL + """, b AS (SELECT entity_id, day, method, max(score) AS score FROM sc GROUP BY ALL),
    e AS (SELECT entity_id, day, sum(score*CASE method WHEN 'isolation_forest' THEN 0.25e0 ELSE 0.2e0 END)/sum(CASE method WHEN 'isolation_forest' THEN 0.25e0 ELSE 0.2e0 END) AS score FROM b GROUP BY ALL)
    SELECT entity_id, day, """ + R("score", "score", 9) + ", CAST(rank() OVER (PARTITION BY entity_id ORDER BY round(score, 9) DESC) AS INTEGER) AS rank, round(score, 9) >= quantile_cont(round(score, 9), 0.9) OVER (PARTITION BY entity_id) AS anomalous FROM e"))
def _(spark, d):
    e = AN.method_ensemble(method_scores(spark, d)).withColumn("score", F.round("score", 9))
    return W.ensemble_rank(e, "score", ["entity_id"]).select("entity_id", "day", r6("score", 9).alias("score"), "rank", "anomalous")


@register("method_agreement", sql("ls", SPC_BASE + ", " + METHOD_SQL + """, q AS (SELECT *, quantile_cont(score, 0.9) OVER (PARTITION BY entity_id, method) AS cut FROM sc)
    SELECT entity_id, method, bool_or(score >= cut AND abs(date_diff('day', day, DATE '1998-06-01')) <= 1) AS detected FROM q GROUP BY ALL"""))
def _(spark, d):
    ev = A.line_daily(spark, d).select("entity_id").distinct().withColumn("event_date", F.lit(CUT))
    return AN.method_agreement(method_scores(spark, d), ev).select("entity_id", "method", "detected")


@register("five_method_ensemble")
def _(spark, d):
    """All five detectors into one ranked score."""
    line = A.line_daily(spark, d)
    rec = AN.window_reconstruction(line, LM, F.col("day") < F.lit(CUT)).select("entity_id", "day", (F.col("error") / F.col("threshold")).alias("score"), F.lit("reconstruction").alias("method"))
    night = DN.dbscan(line, LM, scale=True, eps=1.0).select("entity_id", "day", F.col("distance").alias("score"), F.lit("night_features").alias("method"))
    scores = method_scores(spark, d).unionByName(rec).unionByName(night)
    return W.ensemble_rank(AN.method_ensemble(scores), "score", ["entity_id"])


# --- changepoints ------------------------------------------------------------

DET = """det AS (SELECT entity_id, metric, day, 'shewhart' AS method FROM sp WHERE abs((value-mu)/sigma) > 3
    UNION ALL SELECT entity_id, metric, day, 'level' FROM (SELECT *, avg(value) OVER w + 3*stddev_samp(value) OVER w AS lim FROM ls WINDOW w AS (PARTITION BY entity_id, metric)) WHERE value > lim)"""


def detections(spark, d):
    sig = A.line_signals(spark, d)
    return CP.battery({"shewhart": spc.shewhart(sig, "value", EM).where("action"), "level": AN.level_outliers(sig, "value", EM, 3.0)})


@register("detections", sql("ls", SPC_BASE + ", " + DET + " SELECT * FROM det"))
def _(spark, d):
    return detections(spark, d)


@register("consensus", sql("ls", SPC_BASE + ", " + DET + """, dd AS (SELECT DISTINCT entity_id, day FROM det),
    j AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) > 3 THEN 1 ELSE 0 END AS j FROM dd WINDOW w AS (PARTITION BY entity_id ORDER BY day)),
    i AS (SELECT *, sum(j) OVER (PARTITION BY entity_id ORDER BY day) AS g FROM j),
    k AS (SELECT entity_id, g, list(day ORDER BY day) AS ds FROM i GROUP BY ALL),
    c AS (SELECT i.entity_id, i.g, count(DISTINCT method) AS n_methods, count(DISTINCT metric) AS n_metrics FROM i JOIN det USING (entity_id, day) GROUP BY ALL)
    SELECT entity_id, ds[1 + len(ds)//2] AS date, n_methods, n_metrics, n_methods + n_metrics AS score, n_methods + n_metrics >= 3 AS high_confidence FROM k JOIN c USING (entity_id, g)"""))
def _(spark, d):
    return CP.consensus(detections(spark, d)).select("entity_id", "date", "n_methods", "n_metrics", "score", "high_confidence")


@register("convergence", sql("ld", ZW + " SELECT entity_id, day, CAST(" + " + ".join(f"(abs(z_{m}) > 1.5)::INT" for m in LM) + " AS INTEGER) AS convergence FROM zw"))
def _(spark, d):
    return CP.convergence(line_z(spark, d), [AN.zcol(m) for m in LM]).select("entity_id", "day", "convergence")


PTS = "pts AS (SELECT entity_id, unnest([DATE '1996-06-01', DATE '1998-06-01', DATE '2000-06-01']) AS day FROM (SELECT DISTINCT entity_id FROM ld))"
BA = """ba AS (SELECT p.entity_id, p.day, metric, avg(value) FILTER (WHERE l.day < p.day) AS b, avg(value) FILTER (WHERE l.day >= p.day) AS a, count(*) FILTER (WHERE l.day < p.day) AS bn, count(*) FILTER (WHERE l.day >= p.day) AS an
    FROM pts p JOIN ls l ON l.entity_id = p.entity_id AND abs(date_diff('day', p.day, l.day)) <= 14 GROUP BY ALL)"""


def points(spark, d):
    days = F.array(*[F.lit(date(y, 6, 1)) for y in (1996, 1998, 2000)])
    return A.line_daily(spark, d).select("entity_id").distinct().select("entity_id", F.explode(days).alias("day"))


@register("before_after", sql("ls", PTS + ", " + BA + " SELECT entity_id, day, metric, bn AS before_n, an AS after_n, " + ", ".join([R("b", "before_mean"), R("a", "after_mean"), R("(a-b)/abs(b)*100", "pct")]) + " FROM ba"))
def _(spark, d):
    g = CP.before_after(A.line_signals(spark, d), points(spark, d))
    return g.select("entity_id", "day", "metric", "before_n", "after_n", *[r6(c).alias(c) for c in ("before_mean", "after_mean", "pct")])


@register("classify_points", sql("ls", PTS + ", " + BA + """, p AS (SELECT *, abs((a-b)/abs(b)*100) AS s FROM ba)
    SELECT entity_id, day, arg_max(metric, (round(s, 9), metric)) AS top_metric, count(*) FILTER (WHERE s > 10) AS n_shifted, CASE WHEN count(*) FILTER (WHERE s > 10) >= 2 THEN 'GENUINE' ELSE 'INVESTIGATE' END AS validation FROM p GROUP BY ALL"""))
def _(spark, d):
    sig = A.line_signals(spark, d)
    gaps = J.gap_boundaries(J.wear_gaps(A.line_daily(spark, d), ["entity_id"], min_gap=3), ["entity_id"])
    pts = points(spark, d)
    out = CP.classify_points(CP.before_after(sig, pts), J.nearest_boundary(pts, gaps, ["entity_id"]))
    return out.select("entity_id", "day", "top_metric", "n_shifted", "validation")


@register("segments", sql("ed", """j AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) > 3 THEN 1 ELSE 0 END AS j FROM ed WINDOW w AS (PARTITION BY entity_id, metric ORDER BY day)),
    i AS (SELECT *, sum(j) OVER (PARTITION BY entity_id, metric ORDER BY day) AS g FROM j)
    SELECT entity_id, metric, min(day) AS start_day, max(day) AS end_day, count(*) AS n, """ + R("avg(value)", "mean") + " FROM i GROUP BY entity_id, metric, g HAVING count(*) >= 3"))
def _(spark, d):
    return CP.segments(A.event_daily(spark, d), EM).select(*EM, "start_day", "end_day", "n", r6("mean").alias("mean"))


@register("named_windows", sql("ed", """w(label, a, b) AS (VALUES ('baseline', DATE '2024-01-01', DATE '2024-01-10'), ('travel', DATE '2024-01-11', DATE '2024-01-15'), ('adapted', DATE '2024-01-16', DATE '2024-01-25'), ('after', DATE '2024-01-26', DATE '2024-01-30'))
    SELECT metric, label, count(*) AS n, """ + R("avg(value)", "mean") + " FROM ed JOIN w ON day BETWEEN a AND b GROUP BY ALL"))
def _(spark, d):
    rows = [("baseline", date(2024, 1, 1), date(2024, 1, 10)), ("travel", date(2024, 1, 11), date(2024, 1, 15)), ("adapted", date(2024, 1, 16), date(2024, 1, 25)), ("after", date(2024, 1, 26), date(2024, 1, 30))]
    win = spark.createDataFrame(rows, "label STRING, first_day DATE, last_day DATE")
    return CP.named_windows(A.event_daily(spark, d), win).select("metric", "label", "n", r6("mean").alias("mean"))


@register("bocpd")
def _(spark, d):
    return CP.bayesian_changepoints(A.line_signals(spark, d), recent=3, threshold=0.5)


@register("segmentation")
def _(spark, d):
    return CP.segmentation(A.line_signals(spark, d), weight=1.0)


@register("four_method_consensus")
def _(spark, d):
    """Segmentation, cumulative-sum inflection, run-length model and rolling shift into one consensus."""
    from ..functions.scalar import norm_p2

    sig = A.line_signals(spark, d)
    shift = spc.rolling_shift(sig, "value", EM).where((norm_p2("t") < 0.01) & (F.col("d") > 0.5))
    found = CP.battery({"segmentation": CP.segmentation(sig, weight=1.0), "cusum": spc.cusum_inflection(sig, "value", EM), "run_length": CP.bayesian_changepoints(sig, recent=3), "rolling": shift})
    return CP.consensus(found)
