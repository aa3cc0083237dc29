"""Tests, effect sizes, coupling, trends and resampling."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks, scalar as S, tails
from ..operators import coupling as C, effects as E, resample as RS, trend as T, windows as W
from ..sources import adapters as A
from .registry import R, register

sql, r6 = A.sql, S.r6
EM = ["entity_id", "metric"]
CUT = date(1998, 6, 1)
PRE = "day < DATE '1998-06-01'"


def pre():
    return F.col("day") < F.lit(CUT)


def rounded(df, keep, *cols, digits=6):
    return df.select(*keep, *[r6(c, digits).alias(c) for c in cols])


# --- ranks -------------------------------------------------------------------

MWU = f"""rk AS (SELECT entity_id, metric, {PRE} AS a, rank() OVER (PARTITION BY entity_id, metric ORDER BY value) + (count(*) OVER (PARTITION BY entity_id, metric, value) - 1)/2.0e0 AS r,
      count(*) OVER (PARTITION BY entity_id, metric, value) AS t FROM ls),
    s AS (SELECT entity_id, metric, count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE NOT a) AS n2, sum(r) FILTER (WHERE a) AS r1,
      sum(CAST(t AS DOUBLE)*t - 1) AS ties FROM rk GROUP BY ALL),
    u AS (SELECT *, CAST(n1 AS DOUBLE)*n2 AS nn, r1 - CAST(n1 AS DOUBLE)*(n1+1)/2 AS u1, n1+n2 AS n FROM s),
    z AS (SELECT *, greatest((greatest(u1, nn-u1) - nn/2 - 0.5e0) / sqrt(nn/12 * ((n+1) - ties/(CAST(n AS DOUBLE)*(n-1)))), 0.0e0) AS z FROM u)"""


@register("mann_whitney_u", sql("ls", MWU + " SELECT entity_id, metric, n1, n2, u1, nn-u1 AS u2, " + R("z", "z") + ", " + R(S.norm_p2_sql("z"), "p") + " FROM z"))
def _(spark, d):
    u = ranks.mann_whitney(A.line_signals(spark, d), EM, "value", pre())
    return u.select(*EM, "n1", "n2", "u1", "u2", r6("z").alias("z"), r6(S.norm_p2("z")).alias("p"))


#: Days on either side of the cut, in a small and in a larger test.
AROUND = (3, 12)


def around(spark, d):
    """Days near the cut."""
    sig = A.line_signals(spark, d)
    near = [sig.where(F.abs(F.datediff("day", F.lit(CUT))) <= k).withColumn("reach", F.lit(k)) for k in AROUND]
    return near[0].unionByName(near[1])


@register("mann_whitney_exact", sql("ls", "nr AS (SELECT ls.*, reach FROM ls, (SELECT unnest([" + ", ".join(map(str, AROUND)) + f"""]) AS reach) WHERE abs(date_diff('day', DATE '1998-06-01', day)) <= reach),
    rk AS (SELECT entity_id, metric, reach, {PRE} AS a, 2*rank() OVER (PARTITION BY entity_id, metric, reach ORDER BY value) + count(*) OVER (PARTITION BY entity_id, metric, reach, value) - 1 AS r2,
      count(*) OVER (PARTITION BY entity_id, metric, reach, value) AS t FROM nr),
    g AS (SELECT entity_id, metric, reach, count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE NOT a) AS n2, sum(r2) FILTER (WHERE a) AS s, list(r2 ORDER BY r2) AS rs, sum(CAST(t AS DOUBLE)*t - 1) AS ties FROM rk GROUP BY ALL),
    u AS (SELECT *, CAST(n1 AS DOUBLE)*n2 AS nn, s/2.0e0 - CAST(n1 AS DOUBLE)*(n1+1)/2 AS u1, n1+n2 AS n FROM g WHERE n1 > 0 AND n2 > 0),
    z AS (SELECT *, greatest((greatest(u1, nn-u1) - nn/2 - 0.5e0) / sqrt(nn/12 * ((n+1) - ties/(CAST(n AS DOUBLE)*(n-1)))), 0.0e0) AS z FROM u),
    mk AS (SELECT unnest(range(1, 256)) AS m),
    ex AS (SELECT entity_id, metric, reach, count(*) AS every, count(*) FILTER (abs(list_sum(list_transform(range(n), lambda i: ((m >> i) & 1)*rs[i + 1])) - n1*(n + 1)) >= abs(s - n1*(n + 1))) AS far
      FROM z, mk WHERE n <= 8 AND m < pow(2, n) AND bit_count(m) = n1 GROUP BY ALL)
    SELECT z.entity_id, z.metric, z.reach, n1, n2, u1, """ + R("CASE WHEN n <= 8 THEN far/CAST(every AS DOUBLE) ELSE " + S.norm_p2_sql("z") + " END", "p") + ", CASE WHEN n <= 8 THEN 'exact' ELSE 'normal' END AS method FROM z LEFT JOIN ex USING (entity_id, metric, reach)"))
def _(spark, d):
    """Small tests are counted out, ties included; the twin lists every choice of days."""
    m = ranks.mann_whitney_p(around(spark, d), [*EM, "reach"], "value", pre(), exact_n=8)
    return m.select(*EM, "reach", "n1", "n2", "u1", r6("p").alias("p"), "method")


@register("cliffs_delta", """WITH c AS (SELECT o_orderpriority AS entity_id, o_totalprice AS v, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus <> 'F') AS b
      FROM orders GROUP BY ALL),
    k AS (SELECT *, sum(b) OVER (PARTITION BY entity_id ORDER BY v) - b AS below, sum(b) OVER (PARTITION BY entity_id) AS nb, sum(a) OVER (PARTITION BY entity_id) AS na FROM c),
    g AS (SELECT entity_id, sum(CAST(a AS DOUBLE) * (below - (nb - below - b))) / (max(na)*max(nb)) AS delta FROM k GROUP BY 1)
    SELECT entity_id, """ + R("delta", "delta") + ", CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS label FROM g")
def _(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("entity_id"), F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") == "F").alias("a"))
    u = ranks.mann_whitney(o, ["entity_id"], "v", F.col("a"))
    return u.select("entity_id", r6("delta").alias("delta"), S.named_band(F.abs("delta"), "cliffs_delta").alias("label"))


@register("kruskal_h", """WITH rk AS (SELECT l_linestatus AS entity_id, l_returnflag AS g, rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1)/2.0e0 AS r,
      count(*) OVER (PARTITION BY l_linestatus, l_quantity) AS t FROM lineitem),
    c AS (SELECT entity_id, g, count(*) AS n, sum(r) AS s FROM rk GROUP BY ALL), tt AS (SELECT entity_id, sum(CAST(t AS DOUBLE)*t - 1) AS ties FROM rk GROUP BY 1),
    h AS (SELECT entity_id, sum(n) AS n, sum(s*s/n) AS q, count(*) - 1 AS df FROM c GROUP BY 1)
    SELECT entity_id, CAST(n AS BIGINT) AS n, df, """ + R("(12.0e0/(CAST(n AS DOUBLE)*(n+1))*q - 3*(n+1)) / (1 - ties/(CAST(n AS DOUBLE)*n*n - n))", "h") + " FROM h JOIN tt USING (entity_id)")
def _(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("entity_id"), F.col("l_returnflag").alias("g"), "l_quantity")
    return rounded(ranks.kruskal(li, ["entity_id"], "l_quantity", "g"), ["entity_id", "n", "df"], "h")


MOM = f"""m AS (SELECT entity_id, metric, count(*) FILTER (WHERE {PRE}) AS n1, count(*) FILTER (WHERE NOT {PRE}) AS n2, avg(value) FILTER (WHERE {PRE}) AS m1, avg(value) FILTER (WHERE NOT {PRE}) AS m2,
    var_samp(value) FILTER (WHERE {PRE}) AS v1, var_samp(value) FILTER (WHERE NOT {PRE}) AS v2, stddev_pop(value) FILTER (WHERE {PRE}) AS sp1 FROM ls GROUP BY entity_id, metric)"""


@register("cohens_d", sql("ls", MOM + " SELECT entity_id, metric, n1, n2, " + ", ".join([
    R("(m2-m1)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2))", "d"), R("(m2-m1)/sqrt((v1+v2)/2)", "d_avg"), R("(m2-m1)/sp1", "shift_sd"), R("(m2-m1)/abs(m1)*100", "pct_change")]) + " FROM m"))
def _(spark, d):
    return rounded(E.effect_sizes(E.two_sample(A.line_signals(spark, d), EM, pre())), [*EM, "n1", "n2"], "d", "d_avg", "shift_sd", "pct_change")


@register("welch_t", sql("ls", MOM + " SELECT entity_id, metric, " + ", ".join([
    R("(m1-m2)/sqrt(v1/n1+v2/n2)", "t"), R("(v1/n1+v2/n2)*(v1/n1+v2/n2)/((v1/n1)*(v1/n1)/(n1-1)+(v2/n2)*(v2/n2)/(n2-1))", "df")]) + " FROM m"))
def _(spark, d):
    return rounded(E.welch(E.two_sample(A.line_signals(spark, d), EM, pre())), EM, "t", "df")


@register("welch_p", sql("ls", MOM + ", w AS (SELECT entity_id, metric, (m1-m2)/sqrt(v1/n1+v2/n2) AS t, (v1/n1+v2/n2)*(v1/n1+v2/n2)/((v1/n1)*(v1/n1)/(n1-1)+(v2/n2)*(v2/n2)/(n2-1)) AS df FROM m) SELECT entity_id, metric, "
    + ", ".join([R("t", "t"), R("df", "df"), R(tails.t_p2_sql("t", "df"), "p")]) + " FROM w"))
def _(spark, d):
    """As above with the Student p."""
    return rounded(E.with_t_p(E.welch(E.two_sample(A.line_signals(spark, d), EM, pre()))), EM, "t", "df", "p")


@register("levene_f", sql("ls", f"""c AS (SELECT entity_id, metric, {PRE} AS g, value FROM ls),
    z AS (SELECT *, abs(value - median(value) OVER (PARTITION BY entity_id, metric, g)) AS z FROM c),
    k AS (SELECT entity_id, metric, g, count(*) AS n, avg(z) AS m, var_pop(z) AS v, var_samp(value) AS raw FROM z GROUP BY ALL),
    t AS (SELECT entity_id, metric, sum(n) AS n, count(*) AS k, sum(n*m) AS s, sum(n*m*m) AS q, sum(n*v) AS w, max(raw)/min(raw) AS vr FROM k GROUP BY ALL)
    SELECT entity_id, metric, """ + R("((q - s*s/n)/(k-1))/(w/(n-k))", "f") + ", " + R("vr", "variance_ratio") + " FROM t"))
def _(spark, d):
    return rounded(E.levene(A.line_signals(spark, d).withColumn("g", pre()), EM, "g"), EM, "f", "variance_ratio")


@register("phase_summary", sql("ls", """SELECT entity_id, metric, CASE WHEN day < DATE '1998-06-01' THEN 'pre' WHEN day < DATE '1999-06-01' THEN 'mid' ELSE 'post' END AS phase, count(*) AS n, """
    + ", ".join([R("avg(value)", "mean"), R("median(value)", "median"), R("stddev_samp(value)", "sd")]) + " FROM ls GROUP BY ALL"))
def _(spark, d):
    s = A.line_signals(spark, d).withColumn("phase", S.phase_label("day", CUT, date(1999, 6, 1)))
    return rounded(E.phase_summary(s, EM), [*EM, "phase", "n"], "mean", "median", "sd")


@register("bh_fdr", sql("ls", MWU + f""", p AS (SELECT entity_id, metric, {S.norm_p2_sql('z')} AS p FROM z),
    k AS (SELECT *, p * count(*) OVER (PARTITION BY entity_id) / row_number() OVER (PARTITION BY entity_id ORDER BY p, metric) AS s FROM p WHERE p < 1)
    SELECT entity_id, metric, """ + R("least(min(s) OVER (PARTITION BY entity_id ORDER BY p DESC, metric DESC ROWS UNBOUNDED PRECEDING), 1)", "q") + " FROM k"))
def _(spark, d):
    u = ranks.mann_whitney(A.line_signals(spark, d), EM, "value", pre()).withColumn("p", S.norm_p2("z"))
    return rounded(ranks.benjamini_hochberg(u, ["entity_id"], "p"), EM, "q")


@register("prepost_battery", sql("ls", MWU + ", " + MOM + f""", b AS (SELECT z.entity_id, z.metric, u1, 2*u1/nn - 1 AS delta, {S.norm_p2_sql('z')} AS p, (m2-m1)/sqrt(((m.n1-1)*v1+(m.n2-1)*v2)/(m.n1+m.n2-2)) AS d, (m2-m1)/abs(m1)*100 AS pct_change,
      CASE WHEN m2 > m1 THEN 'up' WHEN m2 < m1 THEN 'down' ELSE 'flat' END AS direction FROM z JOIN m USING (entity_id, metric))
    SELECT entity_id, metric, u1, direction, """ + ", ".join([R("delta", "delta"), R("p", "p"), R("least(p * count(*) OVER (PARTITION BY entity_id), 1)", "p_bonferroni"), R("d", "d"), R("greatest(-80, least(80, pct_change))", "effect")])
    + ", CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS tier FROM b"))
def _(spark, d):
    b = E.forest_table(E.rank_battery(A.line_signals(spark, d), EM, pre(), ["entity_id"]))
    return b.select(*EM, "u1", "direction", *[r6(c).alias(c) for c in ("delta", "p", "p_bonferroni", "d", "effect")], "tier")


# --- coupling ----------------------------------------------------------------

def _spearman_sql(pairs: str, keys: str) -> str:
    return f"""pr AS ({pairs}),
    rk AS (SELECT {keys}, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1)/2.0e0 AS rx,
      rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1)/2.0e0 AS ry FROM pr WHERE x IS NOT NULL AND y IS NOT NULL),
    co AS (SELECT {keys}, count(*) AS n, corr(rx, ry) AS r FROM rk GROUP BY {keys})"""


def _lag_pairs_sql(xs, ys, lags) -> str:
    rows = []
    for x in xs:
        for y in ys:
            for k in lags:
                if x == y and k == 0:
                    continue
                f = f"lead({y}, {k}) OVER w" if k > 0 else f"lag({y}, {-k}) OVER w" if k < 0 else y
                rows.append(f"SELECT entity_id, '{x}' AS x_name, '{y}' AS y_name, {k} AS lag, {x} AS x, {f} AS y FROM ld WINDOW w AS (PARTITION BY entity_id ORDER BY day)")
    return " UNION ALL ".join(f"SELECT * FROM ({r})" for r in rows)


FISHER = "0.5e0*ln((1+greatest(-0.999, least(0.999, r)))/(1-greatest(-0.999, least(0.999, r))))"


@register("spearman", sql("ld", _spearman_sql(_lag_pairs_sql(["qty", "price"], ["disc", "tax"], [0]), "entity_id, x_name, y_name") + " SELECT entity_id, x_name, y_name, n, " + R("r", "r") + " FROM co"))
def _(spark, d):
    p = C.lagged_long(A.line_daily(spark, d), ["qty", "price"], ["disc", "tax"], [0], ["entity_id"])
    return rounded(C.pair_corr(p, ["entity_id", "x_name", "y_name"]), ["entity_id", "x_name", "y_name", "n"], "r")


@register("lag_corr_ci", sql("ld", _spearman_sql(_lag_pairs_sql(["qty", "price"], ["disc", "tax"], [0, 1, 2]), "entity_id, x_name, y_name, lag") + " SELECT entity_id, x_name, y_name, CAST(lag AS INTEGER) AS lag, n, "
    + ", ".join([R("r", "r"), R(f"tanh({FISHER} - {C.Z975}e0/sqrt(n-3))", "ci_lo"), R(f"tanh({FISHER} + {C.Z975}e0/sqrt(n-3))", "ci_hi"), R("r*sqrt((n-2)/(1-r*r))", "t")]) + " FROM co"))
def _(spark, d):
    return rounded(C.lag_table(A.line_daily(spark, d), ["qty", "price"], ["disc", "tax"], [0, 1, 2]), ["entity_id", "x_name", "y_name", "lag", "n"], "r", "ci_lo", "ci_hi", "t")


@register("ccf", sql("ld", _spearman_sql(_lag_pairs_sql(A.LINE_METRICS, A.LINE_METRICS, range(-3, 4)), "entity_id, x_name, y_name, lag") + " SELECT entity_id, x_name, y_name, CAST(lag AS INTEGER) AS lag, n, " + R("r", "r") + " FROM co"))
def _(spark, d):
    """Every ordered pair of metrics, three days back to three ahead."""
    t = C.lag_table(A.line_daily(spark, d), A.LINE_METRICS, A.LINE_METRICS, list(range(-3, 4))).where("NOT (x_name = y_name AND lag = 0)")
    return rounded(t, ["entity_id", "x_name", "y_name", "lag", "n"], "r")


@register("corr_matrix", sql("ld", f"pr AS ({_lag_pairs_sql(A.LINE_METRICS, A.LINE_METRICS, [1])}) SELECT entity_id, x_name, y_name, count(*) AS n, " + R("corr(x, y)", "r") + " FROM pr WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL"))
def _(spark, d):
    return rounded(C.corr_matrix(A.line_daily(spark, d), A.LINE_METRICS, ["entity_id"], lag=1), ["entity_id", "x_name", "y_name", "n"], "r")


@register("corr_p_matrix", sql("ld", f"pr AS ({_lag_pairs_sql(A.LINE_METRICS, A.LINE_METRICS, [0, 1])}), cm AS (SELECT entity_id, x_name, y_name, lag, CAST(count(*) AS DOUBLE) AS n, corr(x, y) AS r FROM pr WHERE x IS NOT NULL AND y IS NOT NULL AND NOT (lag = 0 AND x_name = y_name) GROUP BY ALL) "
    "SELECT entity_id, x_name, y_name, lag, CAST(n AS BIGINT) AS n, " + R("r", "r") + ", " + R(tails.t_p2_sql("(r*sqrt((n - 2)/(1 - r*r)))", "(n - 2)"), "p") + " FROM cm WHERE n > 2 AND abs(r) < 1"))
def _(spark, d):
    """r and its Student p for every pair of metrics, same day and next day."""
    line = A.line_daily(spark, d)
    both = [C.corr_matrix(line, A.LINE_METRICS, ["entity_id"], lag=k).withColumn("lag", F.lit(k)) for k in (0, 1)]
    m = both[0].where("x_name <> y_name").unionByName(both[1]).withColumn("_f", F.col("n").cast("double") - 2)
    p = tails.t_p2(F.col("r") * F.sqrt(F.col("_f") / (1 - F.col("r") * F.col("r"))), F.col("_f"))
    return rounded(m.withColumn("p", p), ["entity_id", "x_name", "y_name", "lag", "n"], "r", "p")


def entity_pairs(spark, d):
    """Every two entities of the dense series, a table as small as the registry of entities."""
    names = A.line_daily(spark, d).select("entity_id").distinct()
    other = F.array_sort(F.collect_set("entity_id"))
    lists = names.agg(other.alias("all"))
    return lists.select(F.explode("all").alias("left_id"), "all").select("left_id", F.explode("all").alias("right_id")).where("left_id < right_id")


@register("fisher_compare", sql("ld", _spearman_sql(_lag_pairs_sql(A.LINE_METRICS, A.LINE_METRICS, [0]), "entity_id, x_name, y_name") + f""", z AS (SELECT *, {FISHER} AS z FROM co)
    SELECT a.entity_id AS left_id, b.entity_id AS right_id, a.x_name, a.y_name, """ + R("(a.z - b.z)/sqrt(1.0e0/(a.n-3) + 1.0e0/(b.n-3))", "z") + " FROM z a JOIN z b ON a.x_name = b.x_name AND a.y_name = b.y_name WHERE a.entity_id < b.entity_id"))
def _(spark, d):
    p = C.lagged_long(A.line_daily(spark, d), A.LINE_METRICS, A.LINE_METRICS, [0], ["entity_id"]).where("x_name <> y_name")
    co = C.pair_corr(p, ["entity_id", "x_name", "y_name"])
    return rounded(C.compare_correlations(co, ["x_name", "y_name"], entity_pairs(spark, d)), ["left_id", "right_id", "x_name", "y_name"], "z")


@register("coupling_label", sql("ld", _spearman_sql(_lag_pairs_sql(["qty", "price"], ["disc", "tax"], [1]), "entity_id, x_name, y_name") + f""", p AS (SELECT *, {S.norm_p2_sql('(r*sqrt((n-2)/(1-r*r)))')} AS p FROM co)
    SELECT entity_id, x_name, y_name, CASE WHEN r > 0.15 AND p < 0.10 THEN 'positive' WHEN r < -0.15 AND p < 0.10 THEN 'negative' ELSE 'absent' END AS direction,
    CASE WHEN abs(r) <= 0.15 OR p >= 0.10 THEN 'negligible' WHEN abs(r) > 0.4 THEN 'strong' WHEN abs(r) > 0.25 THEN 'moderate' ELSE 'weak' END AS strength FROM p"""))
def _(spark, d):
    t = C.lag_table(A.line_daily(spark, d), ["qty", "price"], ["disc", "tax"], [1]).withColumn("p", S.norm_p2("t"))
    return C.coupling_label(t).select("entity_id", "x_name", "y_name", "direction", "strength")


@register("coupling_exact_p", sql("ld", _spearman_sql(_lag_pairs_sql(["qty", "price"], ["disc", "tax"], [0, 1, 2]), "entity_id, x_name, y_name, lag")
    + ", p AS (SELECT *, " + tails.t_p2_sql("(r*sqrt((n-2)/(1-r*r)))", "(n-2)") + " AS p FROM co) SELECT entity_id, x_name, y_name, CAST(lag AS INTEGER) AS lag, " + R("r", "r") + ", " + R("p", "p") + ", p < 0.10 AS sig FROM p"))
def _(spark, d):
    """Lag table with the exact Student p."""
    return rounded(C.significant(C.lag_table(A.line_daily(spark, d), ["qty", "price"], ["disc", "tax"], [0, 1, 2])), ["entity_id", "x_name", "y_name", "lag", "sig"], "r", "p")


@register("dose_response", sql("ld", """p AS (SELECT entity_id, qty AS x, lead(disc) OVER (PARTITION BY entity_id ORDER BY day) AS y FROM ld),
    e AS (SELECT *, quantile_cont(x, 0.25) OVER (PARTITION BY entity_id) AS a, quantile_cont(x, 0.5) OVER (PARTITION BY entity_id) AS b, quantile_cont(x, 0.75) OVER (PARTITION BY entity_id) AS c FROM p WHERE y IS NOT NULL)
    SELECT entity_id, CAST((x > a)::INT + (x > b)::INT + (x > c)::INT AS INTEGER) AS bin, count(*) AS n, """ + ", ".join([R("avg(y)", "mean"), R("min(x)", "dose_lo"), R("max(x)", "dose_hi")]) + " FROM e GROUP BY ALL"))
def _(spark, d):
    bins, _ = C.dose_response(A.line_daily(spark, d), "qty", "disc", ["entity_id"])
    return rounded(bins, ["entity_id", "bin", "n"], "mean", "dose_lo", "dose_hi")


@register("dose_response_test", sql("ld", """p AS (SELECT entity_id, qty AS x, lead(disc) OVER (PARTITION BY entity_id ORDER BY day) AS y FROM ld),
    e AS (SELECT entity_id, y, (x > quantile_cont(x, 0.25) OVER w)::INT + (x > quantile_cont(x, 0.5) OVER w)::INT + (x > quantile_cont(x, 0.75) OVER w)::INT AS g FROM p WHERE y IS NOT NULL WINDOW w AS (PARTITION BY entity_id)),
    rk AS (SELECT *, rank() OVER (PARTITION BY entity_id ORDER BY y) + (count(*) OVER (PARTITION BY entity_id, y) - 1)/2.0e0 AS r, count(*) OVER (PARTITION BY entity_id, y) AS t FROM e),
    c AS (SELECT entity_id, g, count(*) AS n, sum(r) AS s FROM rk GROUP BY ALL), tt AS (SELECT entity_id, sum(CAST(t AS DOUBLE)*t - 1) AS ties FROM rk GROUP BY 1),
    h AS (SELECT entity_id, sum(n) AS n, sum(s*s/n) AS q FROM c GROUP BY 1)
    SELECT entity_id, """ + R("(12.0e0/(CAST(n AS DOUBLE)*(n+1))*q - 3*(n+1)) / (1 - ties/(CAST(n AS DOUBLE)*n*n - n))", "h") + " FROM h JOIN tt USING (entity_id)"))
def _(spark, d):
    _, h = C.dose_response(A.line_daily(spark, d), "qty", "disc", ["entity_id"])
    return rounded(h, ["entity_id"], "h")


@register("convergence_gap", sql("ls", """f AS (SELECT *, row_number() OVER (PARTITION BY entity_id, metric ORDER BY day) <= 14 AS a, row_number() OVER (PARTITION BY entity_id, metric ORDER BY day DESC) <= 14 AS b FROM ls),
    g AS (SELECT entity_id, metric, avg(value) FILTER (WHERE a) AS e, avg(value) FILTER (WHERE b) AS l FROM f GROUP BY ALL)
    SELECT x.entity_id AS left_id, y.entity_id AS right_id, x.metric, """ + R("abs(x.e - y.e)", "gap_early") + ", " + R("abs(x.l - y.l)", "gap_late") + ", abs(x.l - y.l) < abs(x.e - y.e) AS converging FROM g x JOIN g y ON x.metric = y.metric AND x.entity_id < y.entity_id"))
def _(spark, d):
    return rounded(C.convergence_gap(A.line_signals(spark, d), entity_pairs(spark, d)), ["left_id", "right_id", "metric", "converging"], "gap_early", "gap_late")


@register("mediation", sql("ld", """g AS (SELECT entity_id, count(*) AS n, var_samp(qty) AS vx, var_samp(price) AS vm, covar_samp(qty, price) AS xm, covar_samp(qty, tax) AS xy, covar_samp(price, tax) AS my FROM ld GROUP BY 1)
    SELECT entity_id, n, """ + ", ".join([R("xm/vx", "a"), R("xy/vx", "c"), R("(my*vx-xy*xm)/(vx*vm-xm*xm)", "b"), R("(xy*vm-my*xm)/(vx*vm-xm*xm)", "c_prime"), R("xm/vx*(my*vx-xy*xm)/(vx*vm-xm*xm)", "indirect")]) + " FROM g"))
def _(spark, d):
    return rounded(C.mediation(A.line_daily(spark, d), "qty", "price", "tax", ["entity_id"]), ["entity_id", "n"], "a", "c", "b", "c_prime", "indirect")


PATHS = (("qty", "price", "tax"), ("disc", "price", "qty"), ("tax", "qty", "price"), ("t", "qty", "price"))


def _paths_sql() -> str:
    cols = sorted({c for p in PATHS for c in p})
    terms = {"a": "xm/vx", "b": "(my*vx - xy*xm)/(vx*vm - xm*xm)", "c": "xy/vx", "c_prime": "(xy*vm - my*xm)/(vx*vm - xm*xm)", "indirect": "xm/vx*(my*vx - xy*xm)/(vx*vm - xm*xm)"}
    one = " UNION ALL ".join(
        f"SELECT entity_id, rep, '{x}->{m}->{y}' AS path, var_samp({x}) AS vx, var_samp({m}) AS vm, covar_samp({x}, {m}) AS xm, covar_samp({x}, {y}) AS xy, covar_samp({m}, {y}) AS my FROM dr GROUP BY ALL" for x, m, y in PATHS
    )
    every = " UNION ALL ".join(f"SELECT entity_id, path, '{t}' AS term, {e} AS stat FROM g" for t, e in terms.items())
    return f"""v AS (SELECT entity_id, {", ".join(c for c in cols if c != "t")}, date_diff('day', DATE '1992-01-01', day)/100.0e0 AS t, row_number() OVER (PARTITION BY entity_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM ld),
    d AS (SELECT entity_id, rep, {RS.draw_sql('rep', 'i', 42)} % n AS i FROM v, (SELECT unnest(range(1000)) AS rep)),
    dr AS MATERIALIZED (SELECT entity_id, rep, {", ".join(cols)} FROM d JOIN v USING (entity_id, i)),
    g AS MATERIALIZED ({one}), e AS ({every})
    SELECT entity_id, path, term, """ + ", ".join([R("quantile_cont(stat, 0.025)", "ci_lo"), R("quantile_cont(stat, 0.975)", "ci_hi"), R("least(2*least(avg((stat <= 0)::INT), avg((stat >= 0)::INT)), 1)", "p")]) + " FROM e GROUP BY ALL"


@register("mediation_paths", sql("ld", _paths_sql()))
def _(spark, d):
    """Four pathways with intervals and p of every term, the plain slope on time among them."""
    line = A.line_daily(spark, d).withColumn("t", F.datediff("day", F.lit(date(1992, 1, 1))) / F.lit(100.0))
    return rounded(RS.bootstrap_paths(line, PATHS, ["entity_id"]), ["entity_id", "path", "term"], "ci_lo", "ci_hi", "p")


# --- trends ------------------------------------------------------------------

OLS = """x AS (SELECT entity_id, metric, value AS y, date_diff('day', min(day) OVER (PARTITION BY entity_id, metric), day) / 100.0e0 AS t FROM ls),
    o AS (SELECT entity_id, metric, regr_count(y, t) AS n, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, regr_r2(y, t) AS r2, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, regr_sxy(y, t) AS sxy, regr_avgx(y, t) AS xbar FROM x GROUP BY ALL),
    q AS (SELECT *, sqrt((syy - slope*sxy)/(n-2)) AS rs FROM o)"""


def line_trend(spark, d, last=None):
    s = A.line_signals(spark, d)
    if last:
        w = Window.partitionBy(*EM).orderBy(F.desc("day"))
        s = s.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last).drop("_k")
    s = s.withColumn("t", T.day_number(EM) / 100.0)
    return s, T.ols(s, "value", "t", EM)


@register("ols_trend", sql("ls", OLS + " SELECT entity_id, metric, CAST(n AS BIGINT) AS n, " + ", ".join([
    R("slope", "slope"), R("intercept", "intercept"), R("r2", "r2"), R("rs", "resid_sd"), R("rs/sqrt(sxx)", "se"), R("slope/(rs/sqrt(sxx))", "t"), R("slope*sqrt(sxx/syy)", "beta")]) + " FROM q"))
def _(spark, d):
    return rounded(line_trend(spark, d)[1], [*EM, "n"], "slope", "intercept", "r2", "resid_sd", "se", "t", "beta")


TREND_P = ", ".join([R("slope", "slope"), R("rs/sqrt(sxx)", "se"), R(tails.t_p2_sql("slope/(rs/sqrt(sxx))", "n - 2"), "p"),
    R(f"slope - {tails.t975_sql('(n - 2)')}*rs/sqrt(sxx)", "lo"), R(f"slope + {tails.t975_sql('(n - 2)')}*rs/sqrt(sxx)", "hi")])


def tested_trend(fit):
    """Slope with its Student p and 95 % interval."""
    free, reach = F.col("n").cast("double") - 2, tails.t975(F.col("n").cast("double") - 2) * F.col("se")
    out = fit.withColumn("p", tails.t_p2(F.col("slope") / F.col("se"), free)).withColumn("lo", F.col("slope") - reach).withColumn("hi", F.col("slope") + reach)
    return rounded(out, [*EM, "n"], "slope", "se", "p", "lo", "hi")


@register("ols_trend_test", sql("ls", OLS + " SELECT entity_id, metric, CAST(n AS BIGINT) AS n, " + TREND_P + " FROM q"))
def _(spark, d):
    return tested_trend(line_trend(spark, d)[1])


@register("ols_trend_last30", sql("ls", OLS.replace("FROM ls", "FROM (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY entity_id, metric ORDER BY day DESC) <= 30)", 1) + " SELECT entity_id, metric, CAST(n AS BIGINT) AS n, " + TREND_P + " FROM q"))
def _(spark, d):
    """The same over the last 30 days of each series."""
    return tested_trend(line_trend(spark, d, last=30)[1])


@register("prediction_band", sql("ls", OLS + " SELECT entity_id, metric, " + ", ".join([R("intercept + slope*25", "pred"), R(f"intercept + slope*25 - {C.Z975}e0*rs*sqrt(1 + 1.0e0/n + (25-xbar)*(25-xbar)/sxx)", "lo")]) + " FROM q"))
def _(spark, d):
    return rounded(T.prediction_band(line_trend(spark, d)[1], F.lit(25.0)), EM, "pred", "lo")


@register("cosinor", sql("ev", f"""x AS (SELECT metric, value AS y, cos((hour(ts)+minute(ts)/60.0e0)*{2 * math.pi / 24!r}e0) AS c, sin((hour(ts)+minute(ts)/60.0e0)*{2 * math.pi / 24!r}e0) AS s FROM ev),
    g AS (SELECT metric, count(*) AS n, avg(y) AS my, avg(c) AS mc, avg(s) AS ms, var_pop(c) AS cc, var_pop(s) AS ss, covar_pop(c,s) AS cs, covar_pop(c,y) AS cy, covar_pop(s,y) AS sy, var_pop(y) AS yy FROM x GROUP BY 1),
    b AS (SELECT *, (cy*ss - sy*cs)/(cc*ss-cs*cs) AS be, (sy*cc - cy*cs)/(cc*ss-cs*cs) AS ga FROM g)
    SELECT metric, n, """ + ", ".join([R("my - be*mc - ga*ms", "mesor"), R("sqrt(be*be+ga*ga)", "amplitude"),
    R(f"CASE WHEN atan2(ga,be) < 0 THEN atan2(ga,be)*{24 / (2 * math.pi)!r}e0 + 24 ELSE atan2(ga,be)*{24 / (2 * math.pi)!r}e0 END", "peak_h"), R("(be*cy+ga*sy)/yy", "r2")]) + " FROM b"))
def _(spark, d):
    return rounded(T.cosinor(A.samples(spark, d), "value", S.clock_hour("ts"), ["metric"]), ["metric", "n"], "mesor", "amplitude", "peak_h", "r2")


def _tau_sql():
    return "[" + ", ".join(f"{t!r}e0" for t in T.TAU_GRID) + "]"


EXPO = f"""x AS (SELECT entity_id, metric, value AS y, date_diff('day', min(day) OVER (PARTITION BY entity_id, metric), day) AS t FROM ls),
    u AS (SELECT entity_id, metric, y, tau, 1 - exp(-t/tau) AS u FROM x, (SELECT unnest({_tau_sql()}) AS tau)),
    g AS (SELECT entity_id, metric, tau, count(*) AS n, regr_slope(y,u) AS gain, regr_intercept(y,u) AS base, regr_sxx(y,u) AS sxx, regr_sxy(y,u) AS sxy, regr_syy(y,u) AS syy FROM u GROUP BY ALL),
    h AS (SELECT *, greatest(syy - gain*sxy, 0) AS sse FROM g WHERE sxx > 1e-12 AND gain BETWEEN 0 AND 500 AND base BETWEEN -200 AND 200),
    f AS (SELECT *, row_number() OVER (PARTITION BY entity_id, metric ORDER BY round(sse, 9), tau) AS k FROM h)"""


def expo(spark, d):
    s = A.line_signals(spark, d).withColumn("t", T.day_number(EM))
    return s, T.exp_recovery(s, "value", "t", EM)


@register("exp_recovery", sql("ls", EXPO + " SELECT entity_id, metric, tau, n, " + ", ".join([R("gain", "gain"), R("base", "base"), R("1 - sse/syy", "r2")]) + " FROM f WHERE k = 1"))
def _(spark, d):
    return rounded(expo(spark, d)[1], [*EM, "tau", "n"], "gain", "base", "r2")


@register("model_choice", sql("ls", EXPO + """, l AS (SELECT entity_id, metric, count(*) AS n, regr_syy(y,t) - regr_slope(y,t)*regr_sxy(y,t) AS sse FROM x GROUP BY ALL)
    SELECT l.entity_id, l.metric, """ + ", ".join([R("l.n*ln(l.sse/l.n + 1e-15) + 4", "aic_linear"), R("l.n*ln(l.sse/l.n + 1e-15) + 2*ln(l.n)", "bic_linear"), R("f.n*ln(f.sse/f.n + 1e-15) + 6", "aic_exp")])
    + ", CASE WHEN f.n*ln(f.sse/f.n + 1e-15) + 6 < l.n*ln(l.sse/l.n + 1e-15) + 4 THEN 'exponential' ELSE 'linear' END AS best FROM l LEFT JOIN f ON f.entity_id = l.entity_id AND f.metric = l.metric AND f.k = 1"))
def _(spark, d):
    s, curve = expo(spark, d)
    return rounded(T.model_choice(T.ols(s, "value", "t", EM), curve, EM), [*EM, "best"], "aic_linear", "bic_linear", "aic_exp")


@register("target_crossing", sql("ls", OLS.replace(" / 100.0e0 AS t", " AS t") + """, s AS (SELECT *, rs/sqrt(sxx) AS se FROM q),
    k AS (SELECT entity_id, metric, intercept, nm AS scenario, slope + w*se AS b FROM s, (VALUES ('optimistic', 1.0e0), ('expected', 0.0e0), ('pessimistic', -1.0e0)) v(nm, w)),
    c AS (SELECT *, CASE WHEN b > 0 THEN (intercept + 0.001e0 - intercept)/b END AS wait FROM k)
    SELECT entity_id, metric, scenario, CASE WHEN wait BETWEEN 0 AND 365.999999999 THEN CAST(floor(wait) AS BIGINT) END AS linear_days,
      CASE WHEN wait BETWEEN 0 AND 365.999999999 THEN DATE '2001-08-01' + CAST(floor(wait) AS INTEGER) END AS linear_date FROM c"""))
def _(spark, d):
    s = A.line_signals(spark, d).withColumn("t", T.day_number(EM))
    out = T.scenarios(T.ols(s, "value", "t", EM), F.col("intercept") + 0.001, "above", date(2001, 8, 1))
    return out.select(*EM, "scenario", "linear_days", "linear_date")


@register("residual_acf", sql("ls", """e AS (SELECT *, value - avg(value) OVER (PARTITION BY entity_id, metric) AS e FROM ls),
    l AS (SELECT entity_id, metric, e, """ + ", ".join(f"lag(e, {k}) OVER w AS l{k}" for k in range(1, 8)) + " FROM e WINDOW w AS (PARTITION BY entity_id, metric ORDER BY day)), g AS (SELECT entity_id, metric, count(*) AS n, "
    + ", ".join(f"sum(e*l{k})/sum(e*e) AS r{k}" for k in range(1, 8)) + " FROM l GROUP BY ALL), b AS (SELECT *, n*(n+2)*(" + "+".join(f"r{k}*r{k}/(n-{k})" for k in range(1, 8)) + ") AS q FROM g) "
    + " UNION ALL ".join(f"SELECT entity_id, metric, {k} AS lag, " + R("q", "ljung_box") + ", " + R(f"r{k}", "r") + " FROM b" for k in range(1, 8))))
def _(spark, d):
    return rounded(T.residual_acf(A.line_signals(spark, d), "value", EM), [*EM, "lag"], "ljung_box", "r")


# --- resampling --------------------------------------------------------------

@register("bootstrap_mean_diff", sql("od", f"""v AS (SELECT entity_id, {PRE} AS a, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY entity_id, {PRE}) AS n FROM od WINDOW w AS (PARTITION BY entity_id, {PRE} ORDER BY day)),
    d AS (SELECT entity_id, a, rep, CASE WHEN a THEN {RS.draw_sql('rep', 'i', 42)} ELSE {RS.draw_sql('rep', 'i', 43)} END % n AS i FROM v, (SELECT unnest(range(1000)) AS rep)),
    m AS (SELECT entity_id, a, rep, sum(value)/count(*) AS m FROM d JOIN v USING (entity_id, a, i) GROUP BY ALL),
    s AS (SELECT entity_id, rep, sum(CASE WHEN a THEN -m ELSE m END) AS stat FROM m GROUP BY ALL HAVING count(*) = 2)
    SELECT entity_id, """ + ", ".join([R("quantile_cont(stat, 0.025)", "ci_lo"), R("quantile_cont(stat, 0.975)", "ci_hi")]) + " FROM s GROUP BY 1"))
def _(spark, d):
    return rounded(RS.bootstrap_mean_diff(A.order_daily(spark, d), ["entity_id"], pre()), ["entity_id"], "ci_lo", "ci_hi")


@register("block_bootstrap", sql("od", f"""v AS (SELECT entity_id, value, row_number() OVER (PARTITION BY entity_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM od),
    d AS (SELECT entity_id, rep, {RS.draw_sql('rep', '(i//7)', 42)} % (n - 6) + i % 7 AS i FROM v, (SELECT unnest(range(1000)) AS rep)),
    s AS (SELECT entity_id, rep, sum(value)/count(*) AS stat FROM d JOIN v USING (entity_id, i) GROUP BY ALL)
    SELECT entity_id, """ + ", ".join([R("quantile_cont(stat, 0.025)", "ci_lo"), R("quantile_cont(stat, 0.975)", "ci_hi")]) + " FROM s GROUP BY 1"))
def _(spark, d):
    return rounded(RS.block_bootstrap(A.order_daily(spark, d), ["entity_id"]), ["entity_id"], "ci_lo", "ci_hi")


@register("bootstrap_median", sql("od", f"""v AS (SELECT entity_id, value, row_number() OVER (PARTITION BY entity_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM od),
    d AS (SELECT entity_id, rep, {RS.draw_sql('rep', 'i', 42)} % n AS i FROM v, (SELECT unnest(range(1000)) AS rep)),
    s AS (SELECT entity_id, rep, quantile_cont(value, 0.5) AS stat FROM d JOIN v USING (entity_id, i) GROUP BY ALL)
    SELECT entity_id, """ + ", ".join([R("quantile_cont(stat, 0.025)", "ci_lo"), R("quantile_cont(stat, 0.975)", "ci_hi")]) + " FROM s GROUP BY 1"))
def _(spark, d):
    return rounded(RS.bootstrap_stat(A.order_daily(spark, d), ["entity_id"], lambda v: F.percentile(v, F.lit(0.5))), ["entity_id"], "ci_lo", "ci_hi")


@register("poisson_bootstrap", sql("ev", f"""d AS (SELECT metric, value, rep, {RS.draw_sql('rep', 'event_id', 42)} AS d FROM ev, (SELECT unnest(range(200)) AS rep)),
    w AS (SELECT metric, rep, value, {" + ".join(f"(d >= {t})::INT" for t in RS._POISSON)} AS w FROM d),
    s AS (SELECT metric, rep, sum(w*value)/sum(w) AS stat FROM w GROUP BY ALL)
    SELECT metric, """ + ", ".join([R("quantile_cont(stat, 0.025)", "ci_lo"), R("quantile_cont(stat, 0.975)", "ci_hi")]) + " FROM s GROUP BY 1"))
def _(spark, d):
    return rounded(RS.poisson_bootstrap_mean(A.samples(spark, d), ["metric"], "event_id"), ["metric"], "ci_lo", "ci_hi")
