"""URL filter by a path-template tree.

Under each host, path segments form a tree.  Level by level, a node whose children are mostly different values gets
one wildcard child, and literal children whose share of blocked labels does not differ from that of their siblings are
merged into one branch.  A template is rejected by its purity, the share of blocked labels smoothed towards its host's
and that towards the share of all.  Labels are given by listed rules.  Everything runs on counts per (host, path shape),
combined before they are shuffled, so a host with a third of all pages is no larger task than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut
from .registry import register, table

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Path levels that get nodes of their own; what lies deeper is one branch.
DEPTH = 3
#: A node has a wildcard child if it has so many different children and they are that share of its pages.
VARIED, VARIED_SHARE = 5, 0.5
#: Square of the normal deviate up to which two shares count as equal.
SAME = 3.84
#: Pages' worth of the parent's share in a purity, and the purity from which a template is rejected.
PRIOR, REJECT = 4.0, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _level(paths: DataFrame, k: int) -> DataFrame:
    """Extends column node by the branch that segment s{k} falls into."""
    child = cut(paths.groupBy("node", f"s{k}").agg(F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad")))
    # written, so that the join below is one of plain shuffles and Spark can split a node with very many children
    whole = cut(
        child.groupBy("node").agg(
            F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all_n"), F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad")
        )
    )
    lab, bad, rest_lab, rest_bad = F.col("lab"), F.col("bad"), F.col("all_lab") - F.col("lab"), F.col("all_bad") - F.col("bad")
    share = F.col("all_bad") / F.col("all_lab")
    gap = bad / lab - rest_bad / rest_lab
    z2 = gap * gap / (share * (1 - share) * (1 / lab + 1 / rest_lab))
    alike = (lab == 0) | (rest_lab == 0) | (F.col("all_bad") == 0) | (F.col("all_bad") == F.col("all_lab"))
    branch = (
        F.when(F.col(f"s{k}") == "", "")
        .when((F.col("kinds") >= VARIED) & (F.col("kinds") >= VARIED_SHARE * F.col("all_n")), "*")
        .when(alike, "~").when(z2 < SAME, "~").otherwise(F.col(f"s{k}"))
    )
    chosen = child.join(whole, "node").select("node", f"s{k}", branch.alias("branch"))
    return paths.join(chosen, ["node", f"s{k}"]).withColumn("node", F.concat_ws("/", "node", "branch")).drop("branch")


def judge_urls(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each input row.

    A null url, or one without ``://``, has host and path empty and is judged by the template of those; repeated rows
    count as often as they occur; urls of any length are read whole, segments deeper than DEPTH counting as one branch;
    a url on the purity limit is blocked; with no labelled page at all everything is allowed; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"))
    host, path = url_parts(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), says.alias("says"))
    part = F.split(F.regexp_replace("path", "^/", ""), "/")
    levels = [F.coalesce(F.get(part, F.lit(k)), F.lit("")).alias(f"s{k}") for k in range(DEPTH)]
    rows = rows.select("*", *levels, (F.size(part) > DEPTH).alias("deep"))
    shape = ["host", *(f"s{k}" for k in range(DEPTH)), "deep"]
    paths = rows.groupBy(*shape).agg(
        F.count(F.lit(1)).alias("n"), F.count("says").alias("lab"), F.count(F.when(F.col("says") == "block", 1)).alias("bad")
    ).withColumn("node", F.col("host"))
    for k in range(DEPTH):
        paths = _level(paths, k)
    paths = cut(paths.withColumn("template", F.concat("node", F.when(F.col("deep"), "/**").otherwise(""))))
    sums = [F.sum("lab").alias("lab"), F.sum("bad").alias("bad")]
    every = paths.agg(*sums).first()
    share = (every.bad or 0) / max(every.lab or 0, 1)
    hosts = paths.groupBy("host").agg(*sums).select("host", ((F.col("bad") + PRIOR * share) / (F.col("lab") + PRIOR)).alias("p1"))
    purity = (
        paths.groupBy("host", "template").agg(*sums).join(hosts, "host")
        .select("host", "template", ((F.col("bad") + PRIOR * F.col("p1")) / (F.col("lab") + PRIOR)).alias("purity"))
    )
    judged = paths.select(*shape, "template").join(purity, ["host", "template"])
    verdict = F.coalesce("says", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return rows.join(judged, shape).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def _oracle() -> str:
    name = verdict = "NULL"
    for rule, says in sorted(RULES, key=lambda r: len(r[0])):
        own, slash, rest = rule.partition("/")
        fits = f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash}{rest}')"
        name, verdict = f"CASE WHEN {fits} THEN '{rule}' ELSE {name} END", f"CASE WHEN {fits} THEN '{says}' ELSE {verdict} END"
    levels = ", ".join(f"coalesce(part[{k + 1}], '') AS s{k}" for k in range(DEPTH))
    sql = f"""
    WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    url_parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    ruled AS (SELECT *, {name} AS rule, {verdict} AS says, string_split(regexp_replace(path, '^/', ''), '/') AS part FROM url_parts),
    n0 AS (SELECT *, {levels}, len(part) > {DEPTH} AS deep, host AS node FROM ruled)"""
    for k in range(DEPTH):
        sql += f""",
    c{k} AS (SELECT node, s{k}, count(*) AS n, count(says) AS lab, count(*) FILTER (says = 'block') AS bad FROM n{k} GROUP BY ALL),
    w{k} AS (SELECT *, count(*) OVER w AS kinds, sum(n) OVER w AS all_n, sum(lab) OVER w AS all_lab, sum(bad) OVER w AS all_bad
             FROM c{k} WINDOW w AS (PARTITION BY node)),
    b{k} AS (SELECT node, s{k}, CASE WHEN s{k} = '' THEN '' WHEN kinds >= {VARIED} AND kinds >= {VARIED_SHARE} * all_n THEN '*'
             WHEN lab = 0 OR all_lab = lab OR all_bad = 0 OR all_bad = all_lab THEN '~'
             WHEN pow(bad / lab - (all_bad - bad) / (all_lab - lab), 2)
                  / (all_bad / all_lab * (1 - all_bad / all_lab) * (1 / lab + 1 / (all_lab - lab))) < {SAME} THEN '~' ELSE s{k} END AS branch FROM w{k}),
    n{k + 1} AS (SELECT n{k}.* EXCLUDE (node), n{k}.node || '/' || branch AS node FROM n{k} JOIN b{k} USING (node, s{k}))"""
    return sql + f""",
    t AS (SELECT *, node || CASE WHEN deep THEN '/**' ELSE '' END AS template FROM n{DEPTH}),
    p0 AS (SELECT count(*) FILTER (says = 'block') / greatest(count(says), 1) AS p0 FROM t),
    p1 AS (SELECT host, (count(*) FILTER (says = 'block') + {PRIOR} * any_value(p0)) / (count(says) + {PRIOR}) AS p1 FROM t, p0 GROUP BY host),
    p2 AS (SELECT host, template, (count(*) FILTER (says = 'block') + {PRIOR} * any_value(p1)) / (count(says) + {PRIOR}) AS purity
           FROM t JOIN p1 USING (host) GROUP BY host, template)
    SELECT page_id, host, path, rule, coalesce(says, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template
    FROM t JOIN p2 USING (host, template)"""


@register("op2_url_filter", _oracle())
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")
