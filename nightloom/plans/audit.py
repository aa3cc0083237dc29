"""Claim audit over pages whose statistics are derived from the sample table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip_markup
from ..operators import audit as AU
from ..sources import adapters as A
from .registry import ORACLES, R, register

sql = A.sql

_LEAD = "Summary of the nightly recovery score against the baseline window gives "


def reports(spark, d):
    """Each page with a paragraph of statistics of one entity, and the document they come from."""
    st = A.samples(spark, d).groupBy("entity_id").agg(F.sum("cents").alias("c"), F.count("*").alias("n"))
    pages = A.table(spark, d, "pages").select("page_id", "html", (F.col("page_id") % st.count()).alias("entity_id"))
    j = pages.join(st, "entity_id")
    c, n = F.col("c"), F.col("n")
    p1, p2 = (c % 40) / 1000, ((c + n % 2) % 40) / 1000
    r, dd, r2 = (c % 1801 - 900) / 1000, (c % 501 - 250) / 100, (n % 100) / 100
    f3 = lambda x: F.format_string("%.3f", x)
    para = F.concat(
        F.lit(f"<div><b>{_LEAD}</b>p = "), f3(p1), F.lit(f" in the first part of the series.</div><div><b>{_LEAD}</b>p = "), f3(p2),
        F.lit(" in the second part of the series. Coupling of both was r = "), F.format_string("%+.3f", r),
        F.lit(" with R&sup2; = "), F.format_string("%.2f", r2), F.lit(" and Cohen&#39;s d = "), F.format_string("%.2f", dd), F.lit(" over the window.</div>"))
    doc = F.to_json(F.struct(
        F.lit("score").alias("label"), F.struct(p1.alias("p_value"), (p1 + (n % 3) * 0.02).alias("other_p_value")).alias("tests"),
        F.array(F.struct((r + (n % 4) * 0.03).alias("correlation"))).alias("links"), r2.alias("r_squared"), dd.alias("cohens_d")))
    return j.select("page_id", F.concat("html", para).alias("html"), doc.alias("doc"), p1.alias("p1"), p2.alias("p2"))


_NUM = """st AS (SELECT entity_id, CAST(sum(cents) AS BIGINT) AS c, count(*) AS n FROM ev GROUP BY 1),
    nu AS (SELECT page_id, html, n, (c % 40)/1000.0e0 AS p1, ((c + n % 2) % 40)/1000.0e0 AS p2, (c % 1801 - 900)/1000.0e0 AS r, (c % 501 - 250)/100.0e0 AS dd, (n % 100)/100.0e0 AS r2 FROM pages CROSS JOIN (SELECT count(*) AS k FROM st) JOIN st ON entity_id = page_id % k)"""
_CL = """cl AS (SELECT page_id, 'p_value' AS stat_type, p1 AS value FROM nu UNION ALL SELECT page_id, 'p_value', p2 FROM nu UNION ALL SELECT page_id, 'correlation', r FROM nu
    UNION ALL SELECT page_id, 'r_squared', r2 FROM nu UNION ALL SELECT page_id, 'cohens_d', dd FROM nu)"""


@register("strip_markup", "SELECT page_id, length(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) AS n_chars FROM pages")
def _(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.length(strip_markup("html")).cast("bigint").alias("n_chars"))


@register("claims", sql("ev", _NUM + ", " + _CL + " SELECT page_id, stat_type, CAST(round(value, 3) AS DOUBLE) AS value FROM cl"))
def _(spark, d):
    return AU.extract_claims(reports(spark, d)).select("page_id", "stat_type", "value")


@register("json_references", sql("ev", _NUM + """ SELECT page_id, 'tests.p_value' AS path, 'p_value' AS stat_type, round(p1, 6) AS value FROM nu UNION ALL SELECT page_id, 'tests.other_p_value', 'p_value', round(p1 + (n%3)*0.02e0, 6) FROM nu
    UNION ALL SELECT page_id, 'links[0].correlation', 'correlation', round(r + (n%4)*0.03e0, 6) + 0.0e0 FROM nu UNION ALL SELECT page_id, 'r_squared', 'r_squared', round(r2, 6) FROM nu UNION ALL SELECT page_id, 'cohens_d', 'cohens_d', round(dd, 6) + 0.0e0 FROM nu"""))
def _(spark, d):
    refs = AU.extract_references(reports(spark, d).select("page_id", "doc"))
    return refs.select("page_id", "path", "stat_type", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@register("claim_match", sql("ev", _NUM + """, cl AS (SELECT page_id, 'p_value' AS stat_type, p1 AS value, p1 AS a, p1 + (n%3)*0.02e0 AS b FROM nu UNION ALL SELECT page_id, 'p_value', p2, p1, p1 + (n%3)*0.02e0 FROM nu
    UNION ALL SELECT page_id, 'correlation', r, r + (n%4)*0.03e0, r + (n%4)*0.03e0 FROM nu UNION ALL SELECT page_id, 'r_squared', r2, r2, r2 FROM nu UNION ALL SELECT page_id, 'cohens_d', dd, dd, dd FROM nu),
    dc AS (SELECT *, CASE WHEN value = round(value, 0) THEN 0 WHEN value = round(value, 1) THEN 1 WHEN value = round(value, 2) THEN 2 ELSE 3 END AS k FROM cl),
    de AS (SELECT *, least(abs(value-a), abs(value-b)) AS delta, abs(round(a, k) - value) < 1e-10 OR abs(round(b, k) - value) < 1e-10 AS exact FROM dc)
    SELECT stat_type, CASE WHEN exact OR delta <= 0.005 THEN 'matched' WHEN delta >= 0.5 THEN 'unmatched' WHEN delta > 0.05 THEN 'error' ELSE 'warning' END AS verdict, count(*) AS n FROM de GROUP BY ALL"""))
def _(spark, d):
    rep = reports(spark, d)
    m = AU.cross_reference(AU.extract_claims(rep), AU.extract_references(rep.select("page_id", "doc")))
    return m.groupBy("stat_type", "verdict").agg(F.count("*").alias("n"))


@register("claim_conflicts", sql("ev", _NUM + " SELECT page_id, CAST(2 AS BIGINT) AS n_values, CAST(2 AS BIGINT) AS n_claims, least(p1, p2) AS low, greatest(p1, p2) AS high FROM nu WHERE p1 <> p2"))
def _(spark, d):
    return AU.self_conflicts(AU.extract_claims(reports(spark, d))).select("page_id", "n_values", "n_claims", "low", "high")


@register("sanity_issues", sql("ev", _NUM + " SELECT page_id, 'p_zero_exact' AS issue, count(*) AS n FROM (SELECT page_id, p1 AS p FROM nu UNION ALL SELECT page_id, p2 FROM nu) WHERE p = 0 GROUP BY page_id"))
def _(spark, d):
    return AU.sanity_issues(AU.extract_claims(reports(spark, d))).groupBy("page_id", "issue").agg(F.count("*").alias("n"))


@register("audit_summary", f"""SELECT verdict AS finding, CAST(sum(n) AS BIGINT) AS n FROM ({ORACLES["claim_match"]}) GROUP BY 1
    UNION ALL SELECT issue, CAST(sum(n) AS BIGINT) FROM ({ORACLES["sanity_issues"]}) GROUP BY 1 UNION ALL SELECT 'inconsistent_self_report', count(*) FROM ({ORACLES["claim_conflicts"]})""")
def _(spark, d):
    rep = reports(spark, d)
    c = AU.extract_claims(rep)
    return AU.audit_summary(AU.cross_reference(c, AU.extract_references(rep.select("page_id", "doc"))), AU.sanity_issues(c), AU.self_conflicts(c))
