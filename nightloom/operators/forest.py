"""Isolation forest as a table of nodes.

Trees grow on samples that integer hashes choose, about ``sample`` rows a tree however many rows a group has, level by
level with windows over (tree, node), which hold at most a sample.  A node is (feature, cut, place of its left child,
length of the path that ends there).  Every row is then scored where it is: one native expression walks all trees, so
no row is copied for a tree.  Hashes, splits and paths are plain arithmetic that SQL can replay.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME = 2147483647
EULER = 0.5772156649015329
#: Rows that one task scores with one copy of a forest.
CHUNK = 1000


#: Multipliers of the parts of a hash, in order.
MULTIPLIERS = (48271, 69621, 16807, 39373)


def int_hash(*parts: Column) -> Column:
    """A whole number in [0, PRIME) from up to four whole numbers in [0, PRIME): a weighted sum, squared twice."""
    x = sum((p.cast("long") * m for p, m in zip(parts, MULTIPLIERS)), F.lit(20011).cast("long")) % PRIME
    for _ in range(2):
        x = F.transform(F.array(x), lambda q: (q * q + 12345) % PRIME)[0]  # the lambda reads x once
    return x


def expected_path(n: Column) -> Column:
    """Mean path length of an unsuccessful search among n rows."""
    n = n.cast("double")
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.log(n - 1) + EULER) - 2 * (n - 1) / n)


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _rows(wide: DataFrame, columns: Sequence[str], by: Sequence[str], day: str) -> DataFrame:
    x = [F.col(c).cast("double") for c in columns]
    return wide.select(*by, day, F.array(*[F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c) for c in x]).alias("x"), F.pmod(F.unix_date(day), F.lit(PRIME)).cast("long").alias("_id"))


def grown_trees(wide: DataFrame, columns: Sequence[str], by: Sequence[str] = ("entity_id",), day: str = "day", trees: int = 200, seed: int = 42, sample: int = 256) -> DataFrame:
    """(by, tree, place, node, feature, cut, child, length): the nodes of every tree, in level order from place 1.

    ``feature`` -1 marks a leaf.  Otherwise a row goes on at place ``child``, or one further if its feature is above the cut.
    """
    by = list(by)
    rows = _rows(wide, columns, by, day)
    known = rows.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    limit = math.ceil(math.log2(max(sample, 2)))
    bar = F.when(F.col("_n") <= sample, F.lit(PRIME)).otherwise(F.floor(F.lit(PRIME * sample) / F.col("_n")))
    known = known.withColumn("_bar", bar)
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: int_hash(F.lit(seed), t, F.col("_id")) < F.col("_bar"))
    # few bytes but much work: the number of partitions is given, so that they are not merged by size
    s = known.repartition(_tasks(wide), *by, day).select(*by, "x", F.explode(drawn).alias("tree")).repartition(_tasks(wide), *by, "tree")
    s = s.select(*by, "tree", "x", F.lit(1).cast("long").alias("node"), F.lit(False).alias("done"), F.array().cast("array<struct<node:bigint,feature:int,cut:double,length:double>>").alias("trail"))
    d = len(columns)
    for level in range(limit + 1):
        w = Window.partitionBy(*by, "tree", "node")
        s = s.select(
            "*", F.count(F.lit(1)).over(w).alias("n"), F.array(*[F.min(F.col("x")[j]).over(w) for j in range(d)]).alias("lo"), F.array(*[F.max(F.col("x")[j]).over(w) for j in range(d)]).alias("hi")
        )
        s = s.withColumn("usable", F.filter(F.array(*[F.lit(j) for j in range(d)]), lambda j: F.get("hi", j) > F.get("lo", j)))
        split = ~F.col("done") & (F.col("n") > 1) & (F.size("usable") > 0) & F.lit(level < limit)
        s = s.withColumn("split", split)
        pick = int_hash(F.lit(seed), F.col("tree"), F.col("node"), F.lit(1)) % F.size("usable")
        s = s.withColumn("feature", F.when(F.col("split"), F.get("usable", pick.cast("int"))).otherwise(-1))
        low, high = F.get("lo", F.col("feature")), F.get("hi", F.col("feature"))
        at = low + (int_hash(F.lit(seed), F.col("tree"), F.col("node"), F.lit(2)) / PRIME) * (high - low)
        s = s.withColumn("cut", F.when(F.col("split"), F.when(at >= high, low).otherwise(at)))
        step = F.struct("node", "feature", "cut", F.when(~F.col("split"), level + expected_path(F.col("n"))).alias("length"))
        s = s.select(
            *by, "tree", "x", F.when(F.col("split"), 2 * F.col("node") + (F.get("x", F.col("feature")) > F.col("cut")).cast("long")).otherwise(F.col("node")).alias("node"),
            (~F.col("split")).alias("done"), F.when(F.col("done"), F.col("trail")).otherwise(F.concat("trail", F.array(step))).alias("trail"),
        )
    nodes = s.select(*by, "tree", F.explode("trail").alias("t")).select(*by, "tree", "t.*").distinct()
    order = Window.partitionBy(*by, "tree").orderBy("node")  # at most two nodes for each sampled row
    # both children of a node exist, so in level order the k-th inner node's children are at 2k and 2k + 1
    inner = F.sum((F.col("feature") >= 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return nodes.select("*", F.row_number().over(order).alias("place"), F.when(F.col("feature") >= 0, 2 * inner).cast("int").alias("child"))


def isolation_forest(wide: DataFrame, columns: Sequence[str], by: Sequence[str] = ("entity_id",), day: str = "day", trees: int = 200, contamination: float = 0.1, seed: int = 42, sample: int = 256) -> DataFrame:
    """Isolation score per day of each group; the most isolated ``contamination`` share is flagged.

    ``raw_score`` is 2 ** (-mean path / expected path), ``forest_score`` the same stretched to 0..1 within the group.  Nulls and NaN count
    as 0; the score does not depend on the scale of a column.
    """
    by = list(by)
    # a leaf leads to itself, so that every walk takes the same number of steps
    cells = F.struct(
        "place", F.greatest("feature", F.lit(0)).alias("feature"), F.coalesce("cut", F.lit(float("inf"))).alias("cut"), F.coalesce("child", "place").alias("child"), "length"
    )
    grown = grown_trees(wide, columns, by, day, trees, seed, sample).groupBy(*by, "tree").agg(F.sort_array(F.collect_list(cells)).alias("nodes"))
    forests = grown.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("tree", "nodes"))), lambda t: t["nodes"]).alias("forest"))
    rows = _rows(wide, columns, by, day)
    facts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("chunks", F.ceil(F.col("_n") / CHUNK).cast("int"))
    # a forest goes to each chunk of its group's rows, so that a large group spreads over tasks
    copies = forests.join(facts, by).select(*by, "forest", F.least("_n", F.lit(sample)).alias("n"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    chunk = F.pmod(F.xxhash64(day), F.col("chunks")).cast("int").alias("chunk")
    dealt = rows.join(facts, by).select(*by, day, "x", chunk).repartition(_tasks(wide), *by, "chunk")
    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(max(sample, 2)))))

    def path(nodes: Column) -> Column:
        here = lambda at, c: F.element_at(nodes, at)[c]
        go = lambda at, _: here(at, "child") + (F.get("x", here(at, "feature")) > here(at, "cut")).cast("int")
        return here(F.aggregate(steps, F.lit(1), go), "length")

    total = F.aggregate("forest", F.lit(0.0), lambda acc, nodes: acc + path(nodes))
    scored = dealt.join(copies, [*by, "chunk"])
    norm = F.when(F.col("n") > 2, expected_path(F.col("n"))).otherwise(1.0)
    scored = scored.select(*by, day, F.pow(F.lit(2.0), -(total / F.size("forest")) / norm).alias("raw_score"))
    w = Window.partitionBy(*by)
    lo, hi = F.min("raw_score").over(w), F.max("raw_score").over(w)
    bar = F.percentile("raw_score", F.lit(1 - contamination)).over(w)
    # compared after rounding, so that sums in another order flag the same days
    return scored.select(
        *by, day, "raw_score", F.when(hi > lo, (F.col("raw_score") - lo) / (hi - lo)).otherwise(0.0).alias("forest_score"),
        (F.round("raw_score", 9) > F.round(bar, 9)).alias("forest_anomaly"),
    )


def forest_sql(source: str, columns: Sequence[str], trees: int = 200, contamination: float = 0.1, seed: int = 42, sample: int = 256) -> str:
    """The same forest replayed in SQL over ``source`` (entity_id, day, columns); ends in ``fo``."""

    def h(*parts: str) -> str:
        x = "(20011 + " + " + ".join(f"({p})::BIGINT*{m}" for p, m in zip(parts, MULTIPLIERS)) + f") % {PRIME}"
        for _ in range(2):
            x = f"list_transform([{x}], lambda q: (q*q + 12345) % {PRIME})[1]"
        return x

    limit = math.ceil(math.log2(max(sample, 2)))
    path = lambda n: f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2*(ln({n} - 1) + {EULER}) - 2*({n} - 1)/CAST({n} AS DOUBLE) END"
    d = len(columns)
    out = [
        f"""fr AS MATERIALIZED (SELECT entity_id, day, [{", ".join(f"coalesce(CAST({c} AS DOUBLE), 0)" for c in columns)}] AS x,
            CAST(date_diff('day', DATE '1970-01-01', day) AS BIGINT) AS id, count(*) OVER (PARTITION BY entity_id) AS nn FROM {source})""",
        f"""f0 AS MATERIALIZED (SELECT entity_id, tree, x, 1::BIGINT AS node, false AS done FROM fr, (SELECT unnest(range({trees})) AS tree)
            WHERE {h(str(seed), "tree", "id")} < CASE WHEN nn <= {sample} THEN {PRIME} ELSE ({PRIME}::BIGINT*{sample}) // nn END)""",
    ]
    for level in range(limit + 1):
        usable = f"list_filter(range({d}), lambda j: hi[j + 1] > lo[j + 1])"
        out += [
            f"""g{level} AS (SELECT *, count(*) OVER w AS n, [{", ".join(f"min(x[{j + 1}]) OVER w" for j in range(d))}] AS lo, [{", ".join(f"max(x[{j + 1}]) OVER w" for j in range(d))}] AS hi
                FROM f{level} WHERE NOT done WINDOW w AS (PARTITION BY entity_id, tree, node))""",
            f"""us{level} AS (SELECT *, {usable} AS us FROM g{level})""",
            f"""k{level} AS (SELECT *, CASE WHEN n > 1 AND len(us) > 0 AND {level} < {limit} THEN us[1 + ({h(str(seed), "tree", "node", "1")}) % len(us)] ELSE -1 END AS f FROM us{level})""",
            f"""q{level} AS (SELECT *, lo[f + 1] + (({h(str(seed), "tree", "node", "2")})/CAST({PRIME} AS DOUBLE))*(hi[f + 1] - lo[f + 1]) AS c FROM k{level})""",
            f"""l{level} AS MATERIALIZED (SELECT entity_id, tree, x, node, n, f, CASE WHEN f >= 0 THEN CASE WHEN c >= hi[f + 1] THEN lo[f + 1] ELSE c END END AS cut FROM q{level})""",
            f"""n{level} AS MATERIALIZED (SELECT DISTINCT entity_id, tree, node, f, cut, CASE WHEN f < 0 THEN {level} + {path("n")} END AS length FROM l{level})""",
        ]
        if level < limit:
            out.append(f"f{level + 1} AS MATERIALIZED (SELECT entity_id, tree, x, 2*node + (x[f + 1] > cut)::BIGINT AS node, false AS done FROM l{level} WHERE f >= 0)")
    out.append("w0 AS (SELECT entity_id, day, x, tree, f, cut, length, node FROM fr JOIN n0 USING (entity_id))")
    for level in range(1, limit + 1):
        out.append(
            f"""w{level} AS MATERIALIZED (SELECT w.entity_id, w.day, w.x, w.tree, n.f, n.cut, n.length, n.node FROM w{level - 1} w JOIN n{level} n
                ON n.entity_id = w.entity_id AND n.tree = w.tree AND n.node = 2*w.node + (w.x[w.f + 1] > w.cut)::BIGINT WHERE w.f >= 0)"""
        )
    leaves = " UNION ALL ".join(f"SELECT entity_id, day, length FROM w{level} WHERE f < 0" for level in range(limit + 1))
    norm = f"CASE WHEN least(nn, {sample}) > 2 THEN {path(f'least(nn, {sample})')} ELSE 1 END"
    out += [
        f"sv AS MATERIALIZED (SELECT entity_id, day, pow(2, -avg(length)/any_value({norm})) AS raw_score FROM ({leaves}) JOIN (SELECT entity_id, day, nn FROM fr) USING (entity_id, day) GROUP BY ALL)",
        f"""fo AS MATERIALIZED (SELECT entity_id, day, raw_score, CASE WHEN max(raw_score) OVER e > min(raw_score) OVER e THEN (raw_score - min(raw_score) OVER e)/(max(raw_score) OVER e - min(raw_score) OVER e) ELSE 0 END AS forest_score,
            round(raw_score, 9) > round(quantile_cont(raw_score, {1 - contamination}) OVER e, 9) AS forest_anomaly FROM sv WINDOW e AS (PARTITION BY entity_id))""",
    ]
    return ",\n".join(out)
