"""Density clusters by equality joins on a grid.

Equal points are one point with a weight.  A point's neighbours lie in its own grid cell of side ``eps`` or in an
adjacent one, so pairs come from an equality join on cells and a distance filter; a grid over a few of the columns finds
a superset of the neighbours, which the filter corrects.  Points with enough neighbours are core; links between cores
spread the least day of a cluster through the shared checkpoint folder until nothing changes; other points take the first
cluster that one of their core neighbours belongs to.  Pairs are only counted and followed, never gathered.

The silhouette uses squared distances, whose mean over a cluster follows from the cluster's count and sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage as cut

#: Columns that the grid uses: 3 ** GRID cells are searched for each point.
GRID = 3


def _filled(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)


def standardized(wide: DataFrame, columns: Sequence[str], by: Sequence[str], scale: bool) -> DataFrame:
    """Columns with gaps as zero; with ``scale`` centred and divided by the population sd of their group (1 where that is 0)."""
    rows = wide.select(*[c for c in wide.columns if c not in columns], *[_filled(c).alias(c) for c in columns])
    if not scale:
        return rows
    facts = rows.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    sd = lambda c: F.when(F.col(f"_s_{c}") > 1e-12, F.col(f"_s_{c}")).otherwise(1.0)
    joined = rows.join(facts, list(by))
    return joined.select(*[c for c in rows.columns if c not in columns], *[((F.col(c) - F.col(f"_m_{c}")) / sd(c)).alias(c) for c in columns])


def near_pairs(points: DataFrame, columns: Sequence[str], by: Sequence[str], ident: str, eps: float, grid: int = GRID) -> DataFrame:
    """(by, u, v, weight of v) of the ordered pairs of different points within ``eps``."""
    axes = list(columns)[:grid]
    cell = [F.floor(F.col(c) / eps).alias(f"_g{i}") for i, c in enumerate(axes)]
    steps = F.array(*[F.array(*[F.lit(s) for s in step]) for step in product((-1, 0, 1), repeat=len(axes))])
    left = points.select(*by, F.col(ident).alias("u"), *[F.col(c).alias(f"_a{i}") for i, c in enumerate(columns)], *cell, F.explode(steps).alias("_step"))
    left = left.select(*by, "u", *[f"_a{i}" for i in range(len(columns))], *[(F.col(f"_g{i}") + F.col("_step")[i]).alias(f"_g{i}") for i in range(len(axes))])
    right = points.select(*by, F.col(ident).alias("v"), "weight", *[F.col(c).alias(f"_b{i}") for i, c in enumerate(columns)], *cell)
    far = sum(((F.col(f"_a{i}") - F.col(f"_b{i}")) * (F.col(f"_a{i}") - F.col(f"_b{i}")) for i in range(len(columns))), F.lit(0.0))
    met = left.join(right, [*by, *[f"_g{i}" for i in range(len(axes))]])
    return met.where((F.col("u") != F.col("v")) & (far <= eps * eps)).select(*by, "u", "v", "weight")


def least_reachable(links: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, u, label): the least end reachable over links (by, u, v) that are given in both directions.

    Each round takes the least label among the neighbours and then the label of that label, through a checkpoint.
    """
    by = list(by)
    labels = cut(links.groupBy(*by, "u").agg(F.least("u", F.min("v")).alias("label")))
    while True:
        heard = links.join(labels.select(*by, F.col("u").alias("v"), "label"), [*by, "v"]).groupBy(*by, "u").agg(F.min("label").alias("heard"))
        told = labels.join(heard, [*by, "u"]).select(*by, "u", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        above = labels.select(*by, F.col("u").alias("label"), F.col("label").alias("above"))
        new = cut(told.join(above, [*by, "label"]).select(*by, "u", "old", F.least("label", "above").alias("label")))
        labels = new.select(*by, "u", "label")
        if new.where("old <> label").isEmpty():
            return labels


def _square(rows: Sequence[Column]) -> Column:
    return sum((x * x for x in rows), F.lit(0.0))


def dbscan(wide: DataFrame, columns: Sequence[str], by: Sequence[str] = ("entity_id",), day: str = "day", eps: float = 1.5, min_samples: int = 3, scale: bool = False, grid: int = GRID) -> DataFrame:
    """Density clusters among the days of each group: by, day, cluster, distance, silhouette.

    A day with ``min_samples`` days within ``eps``, itself included, is core; clusters are numbered from 0 by their first
    core day; a day that is not core takes the least cluster among its core neighbours, and -1 without one.  ``distance``
    is that to the own centroid, for -1 to the nearest one (to the mean of all days where there is no cluster).
    ``silhouette`` is the group's mean over clustered days with squared distances, null below two clusters.  Nulls and NaN
    count as 0.  (by, day) must name a row.
    """
    by, columns = list(by), list(columns)
    rows = cut(standardized(wide.select(*by, day, *columns), columns, by, scale))
    points = cut(rows.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("weight"), F.min(day).alias("u")))
    pairs = cut(near_pairs(points, columns, by, "u", eps, grid))
    counted = points.join(pairs.groupBy(*by, "u").agg(F.sum("weight").alias("_n")), [*by, "u"], "left")
    counted = cut(counted.withColumn("core", F.col("weight") + F.coalesce("_n", F.lit(0)) >= min_samples).drop("_n"))
    core = counted.where("core").select(*by, "u")
    to_core = cut(pairs.join(core.withColumnRenamed("u", "v"), [*by, "v"]).select(*by, "u", "v"))
    links = cut(to_core.join(core, [*by, "u"], "left_semi"))
    labels = core.join(least_reachable(links, by), [*by, "u"], "left").select(*by, "u", F.coalesce("label", "u").alias("label"))
    edge = to_core.join(core, [*by, "u"], "left_anti").join(labels.withColumnRenamed("u", "v"), [*by, "v"]).groupBy(*by, "u").agg(F.min("label").alias("label"))
    # one row for each cluster from here on
    number = F.dense_rank().over(Window.partitionBy(*by).orderBy("label")) - 1
    numbers = labels.select(*by, "label").distinct().withColumn("cluster", number.cast("int"))
    placed = labels.unionByName(edge).join(numbers, [*by, "label"]).select(*by, "u", "cluster")
    named = counted.join(placed, [*by, "u"], "left").select(*by, *columns, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    members = cut(rows.join(named, [*by, *columns]))
    return members.join(_cluster_facts(members, columns, by), by, "left").transform(lambda d: _measured(d, columns, by, day))


def _cluster_facts(members: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """One row for each group: its clusters as (cluster, n, mean, square) and the mean of all rows."""
    found = members.where("cluster >= 0").groupBy(*by, "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in columns]).alias("mean"), F.avg(_square([F.col(c) for c in columns])).alias("square")
    )
    lists = found.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cluster", "n", "mean", "square"))).alias("clusters"))
    overall = members.groupBy(*by).agg(F.array(*[F.avg(c) for c in columns]).alias("overall"))
    return overall.join(lists, by, "left")


def _measured(d: DataFrame, columns: list[str], by: list[str], day: str) -> DataFrame:
    x = [F.col(c) for c in columns]
    far = lambda m: F.sqrt(_square([x[i] - m[i] for i in range(len(x))]))
    own = F.filter("clusters", lambda c: c["cluster"] == F.col("cluster"))[0]
    every = F.transform("clusters", lambda c: far(c["mean"]))
    distance = F.when(F.col("clusters").isNull(), far(F.col("overall"))).when(F.col("cluster") >= 0, far(own["mean"])).otherwise(F.array_min(every))
    # mean squared distance to a cluster's rows: |x|^2 + mean |y|^2 - 2 x.mean(y)
    apart = lambda c: F.greatest(_square(x) + c["square"] - 2 * sum((x[i] * c["mean"][i] for i in range(len(x))), F.lit(0.0)), F.lit(0.0))
    inner = apart(own) * own["n"] / (own["n"] - 1)
    outer = F.array_min(F.transform(F.filter("clusters", lambda c: c["cluster"] != F.col("cluster")), apart))
    top = F.greatest(inner, outer)
    one = F.when(own["n"] < 2, 0.0).when(top > 0, (outer - inner) / top).otherwise(0.0)
    d = d.withColumn("distance", distance).withColumn("_one", F.when((F.col("cluster") >= 0) & (F.size("clusters") > 1), one))
    mean = d.groupBy(*by).agg(F.avg("_one").alias("silhouette"))
    return d.select(*by, day, "cluster", "distance").join(mean, by)
