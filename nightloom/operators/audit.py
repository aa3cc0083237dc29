"""Statistic claims in report text, checked against machine-readable results."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import matches_with_position, squeeze, strip_markup

# Claim patterns, (context before, context after), and words that mark markup or style text.
CLAIMS = {
    "p_value": (r"(?<![a-zA-Z])p\s*[=<>≤≥]\s*\d+\.?\d*(?:[eE][+-]?\d+)?", 60, 30),
    "correlation": (r"(?<![a-zA-Z])r\s*=\s*[+-]?\d+\.?\d*", 40, 20),
    "r_squared": (r"R[²2]\s*=\s*\d+\.?\d*", 40, 20),
    "cohens_d": (r"(?:Cohen.{0,3}s?\s*)?d\s*=\s*[+-]?\d+\.?\d*", 40, 20),
}
STYLE_WORDS = r"(?i)padding|percent|pixel|opacity|font-size|margin|top:|left:|right:|bottom:|width:|height:|span>p>|<p>|</p>|rgb|hsl|grid|flex"
STAT_KEYS = {
    "p_value": "p_value", "p_val": "p_value", "correlation": "correlation",
    "cohens_d": "cohens_d", "r_squared": "r_squared", "effect_size": "effect_size",
}
TOLERANCE = 0.005


def extract_claims(pages: DataFrame, report: str = "page_id", html: str = "html") -> DataFrame:
    """One row per statistic stated in the text: type, operator, value, position and context.

    The text of a page is scanned in its own row; only the claims leave it.
    """
    text = pages.select(report, strip_markup(html).alias("_t"))
    found = []
    for kind, (pattern, back, ahead) in CLAIMS.items():
        def describe(m, kind=kind, back=back, ahead=ahead):
            lo = F.greatest(m["at"] - back, F.lit(1))
            ctx = F.trim(F.substring(F.col("_t"), lo, m["at"] - lo + F.length(m["match"]) + ahead))
            return F.struct(
                F.lit(kind).alias("stat_type"), F.regexp_extract(m["match"], r"([=<>≤≥])", 1).alias("operator"),
                F.regexp_extract(m["match"], r"[=<>≤≥]\s*([+-]?\d+\.?\d*(?:[eE][+-]?\d+)?)$", 1).cast("double").alias("value"),
                (m["at"] - 1).alias("position"), ctx.alias("context"),
            )
        found.append(F.transform(matches_with_position(F.col("_t"), pattern), _one_arg(describe)))
    c = text.select(report, F.inline(F.flatten(F.array(*found))))
    kind, v, ctx = F.col("stat_type"), F.col("value"), F.col("context")
    style = kind.isin("p_value", "correlation") & ctx.rlike(STYLE_WORDS)
    path = (kind == "cohens_d") & ctx.rlike("(?i)path|svg")
    too_big = F.when(kind == "cohens_d", False).otherwise(F.abs(v) > 1)
    return c.where(v.isNotNull() & ~style & ~path & ~too_big)


def _one_arg(fn):
    return lambda m: fn(m)


@F.udtf(returnType="path STRING, key STRING, value DOUBLE, label STRING")
class JsonNumbers:
    """Numeric leaves of a JSON document of any depth, with their path and the label beside them."""

    def eval(self, doc: str) -> Iterator[tuple]:
        try:
            stack = [("", "", json.loads(doc), "")]
        except (TypeError, ValueError):
            return
        while stack:
            path, key, node, label = stack.pop()
            if isinstance(node, dict):
                here = next((str(node[k]) for k in ("label", "feature", "name") if node.get(k)), "")
                stack.extend((f"{path}.{k}" if path else k, k, v, here) for k, v in reversed(node.items()))
            elif isinstance(node, list):
                stack.extend((f"{path}[{i}]", "", v, "") for i, v in reversed(list(enumerate(node))))
            elif isinstance(node, (int, float)) and not isinstance(node, bool) and key:
                yield path, key, float(node), label


def extract_references(docs: DataFrame, report: str = "page_id", doc: str = "doc") -> DataFrame:
    """Numbers of result documents whose key names a statistic."""
    flat = docs.select(report, doc).lateralJoin(JsonNumbers(F.col(doc).outer()))
    kind = None
    for word, stat in STAT_KEYS.items():
        hit = F.lower("key").contains(word)
        kind = F.when(hit, stat) if kind is None else kind.when(hit, stat)
    return flat.select(report, "path", kind.alias("stat_type"), "value", "label").where(F.col("stat_type").isNotNull())


def decimals_shown(v):
    return F.length(F.regexp_replace(F.regexp_extract(F.format_string("%.10f", v), r"\.(\d*)$", 1), "0+$", ""))


def cross_reference(claims: DataFrame, refs: DataFrame, report: str = "page_id", tolerance: float = TOLERANCE) -> DataFrame:
    """Best reference per claim and a verdict: matched, warning, error or unmatched.

    A reference that rounds to the shown value wins (equality join on the
    rounded text); otherwise the nearest one is the last below or the first above
    in value order.  No claim meets every reference.
    """
    keys = [report, "stat_type"]
    c = claims.withColumn("_dec", decimals_shown(F.col("value"))).withColumn("_shown", F.format_string("%.10f", F.col("value")))
    rounded = refs.withColumn("_dec", F.explode(F.sequence(F.lit(0), F.lit(10))))
    shown = None
    for k in range(11):
        text = F.format_string("%.10f", F.round("value", k) + F.lit(0.0))
        shown = F.when(F.col("_dec") == k, text) if shown is None else shown.when(F.col("_dec") == k, text)
    exact = rounded.withColumn("_shown", shown).groupBy(*keys, "_dec", "_shown").agg(F.min_by(F.struct(F.col("path").alias("ref_path"), F.col("value").alias("ref_value")), "path").alias("_x"))
    c = c.join(exact, [*keys, "_dec", "_shown"], "left")
    # nearest by value: references and claims ordered together inside one report
    cols = [x for x in c.columns if x not in keys]
    both = c.select(*keys, F.col("value").alias("_v"), F.struct(*cols).alias("_c"), F.lit(None).cast("struct<ref_path:string,ref_value:double>").alias("_r")).unionByName(
        refs.select(*keys, F.col("value").alias("_v"), F.lit(None).cast(c.select(F.struct(*cols)).schema[0].dataType).alias("_c"), F.struct(F.col("path").alias("ref_path"), F.col("value").alias("ref_value")).alias("_r"))
    )
    w = Window.partitionBy(*keys).orderBy("_v", F.col("_r.ref_path").asc_nulls_last())
    low = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = both.withColumn("_lo", low).withColumn("_hi", high).where(F.col("_c").isNotNull()).select(*keys, "_c.*", "_lo", "_hi")
    below, above = F.col("value") - F.col("_lo.ref_value"), F.col("_hi.ref_value") - F.col("value")
    near = F.when(F.col("_hi").isNull() | (below <= above), F.col("_lo")).otherwise(F.col("_hi"))
    d = d.withColumn("_best", F.coalesce("_x", near)).withColumn("exact", F.col("_x").isNotNull())
    d = d.withColumn("delta", F.abs(F.col("value") - F.col("_best.ref_value")))
    verdict = (
        F.when(F.col("_best").isNull(), "unmatched").when(F.col("exact") | (F.col("delta") <= tolerance), "matched")
        .when(F.col("delta") >= 0.5, "unmatched").when(F.col("delta") > 0.05, "error").otherwise("warning")
    )
    return d.select(*keys, "operator", "value", "position", "context", "_best.ref_path", "_best.ref_value", "exact", "delta", verdict.alias("verdict"))


def sanity_issues(claims: DataFrame) -> DataFrame:
    kind, v = F.col("stat_type"), F.col("value")
    issue = (
        F.when((kind == "p_value") & (v < 0), "p_negative").when((kind == "p_value") & (v == 0) & (F.col("operator") == "="), "p_zero_exact")
        .when((kind == "correlation") & (F.abs("value") > 1), "correlation_gt_1")
    )
    d = claims.withColumn("issue", issue).where(F.col("issue").isNotNull())
    return d.withColumn("severity", F.when(F.col("issue") == "p_zero_exact", "warning").otherwise("error"))


def self_conflicts(claims: DataFrame, report: str = "page_id") -> DataFrame:
    """p-values stated differently in the same context of one report; values are counted, not collected."""
    ctx = squeeze(F.substring("context", 1, 30))
    per = claims.where(F.col("stat_type") == "p_value").groupBy(report, ctx.alias("context_key"), "value").agg(F.count("*").alias("_n"))
    g = per.groupBy(report, "context_key").agg(F.count("*").alias("n_values"), F.sum("_n").alias("n_claims"), F.min("value").alias("low"), F.max("value").alias("high"))
    return g.where(F.col("n_values") > 1)


def audit_summary(checked: DataFrame, issues: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Counts per kind of finding."""
    a = checked.groupBy(F.col("verdict").alias("finding")).agg(F.count("*").alias("n"))
    b = issues.groupBy(F.col("issue").alias("finding")).agg(F.count("*").alias("n"))
    c = conflicts.agg(F.count("*").alias("n")).select(F.lit("inconsistent_self_report").alias("finding"), "n")
    return a.unionByName(b).unionByName(c)
