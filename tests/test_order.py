"""Streams in any order, merges with null months, selection in two passes, density clusters and forests on planted data."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.functions import ranks
from nightloom.operators import density, forest
from nightloom.sources import sinks
from nightloom.streaming import charts, ingest

T0 = dt.datetime(2024, 1, 1)
SHAPE = "metric STRING, ts TIMESTAMP, value DOUBLE"


def chart_of(spark, folder, rows, parts, name):
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[j] for j in part], SHAPE).coalesce(1).write.parquet(f"{folder}/{name}/{i}")
    files = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}")
    out = ingest.run_available(charts.control_chart(files, ["metric"], delay="60 days"), name)
    return sorted(map(tuple, out.collect()))


def test_chart_does_not_depend_on_the_order_of_rows(spark, folder):
    r = random.Random(1)
    rows = [("a", T0 + dt.timedelta(hours=6 * (i // 2)), r.gauss(0, 1) + (3 if i > 60 else 0)) for i in range(90)]  # equal times in pairs
    rows.append(("a", T0 + dt.timedelta(days=200), 0.0))  # moves the watermark past all others
    order = list(range(90))
    r.shuffle(order)
    one = chart_of(spark, folder, rows, [range(91)], "one")
    many = chart_of(spark, folder, rows, [order[:30], order[30:60], order[60:], [90]], "many")
    assert one == many and len(one) == 90 - 14
    assert {x[-1] for x in one} >= {"OK", "RED"}


def test_sessions_merge_before_the_exchange(spark, folder):
    spark.createDataFrame([("a", T0, 1.0)], "entity_id STRING, ts TIMESTAMP, value DOUBLE").write.parquet(f"{folder}/in")
    stream = ingest.file_stream(spark, f"{folder}/in")
    query = ingest.sessions(stream, ["entity_id"], min_rows=1).writeStream.format("noop").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    lines = [x for x in plan.splitlines() if "MergingSessions" in x or "Exchange" in x]
    below = plan[plan.rindex("Exchange"):]
    assert lines and "MergingSessions" in below


def test_merge_keeps_rows_without_a_month(spark, folder):
    path = f"{folder}/t"
    form = "key INT, month STRING, v INT"
    sinks.merge_into(spark, path, spark.createDataFrame([(1, None, 1), (2, "2024-01", 1), (5, "2024-02", 1)], form), ["key"], ["v"])
    sinks.merge_into(spark, path, spark.createDataFrame([(3, None, 1), (2, "2024-01", 2)], form), ["key"], ["v"])
    got = sorted((r.key, r.month, r.v) for r in spark.read.parquet(path).collect())
    assert got == [(1, None, 1), (2, "2024-01", 2), (3, None, 1), (5, "2024-02", 1)]
    sinks.merge_into(spark, path, spark.createDataFrame([(1, None, 9)], form), ["key"], ["v"])
    assert sorted((r.key, r.v) for r in spark.read.parquet(path).collect()) == [(1, 9), (2, 2), (3, 1), (5, 1)]


def test_quantiles_in_two_passes(spark):
    r = np.random.default_rng(2)
    groups = {"wide": r.normal(0, 1e6, 501), "ties": np.repeat([1.5, -2.0, 0.0], [40, 1, 9]), "one": np.array([7.0]), "close": 1 + r.random(300) * 1e-9}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None), ("wide", float("nan"))]
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.931, "top": 1.0}
    got = {x.g: x for x in ranks.exact_quantiles(spark.createDataFrame(rows, "g STRING, v DOUBLE"), ["g"], "v", probs).collect()}
    for g, xs in groups.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(float(np.quantile(xs, p)), rel=1e-12)


def test_density_clusters_number_borders_and_noise(spark):
    """Two clusters, a border day between them, repeated points, gaps as zero, and a group of noise only."""
    at = [0.0, 0.0, 0.1, 0.3, 1.2, 2.1, 2.2, 2.3, 2.4, 40.0]
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), x, None if i % 2 else 0.0) for i, x in enumerate(at)]
    rows += [("b", dt.date(2024, 1, 1), 1.0, 0.0), ("b", dt.date(2024, 1, 2), 9.0, float("nan"))]
    df = spark.createDataFrame(rows, "entity_id STRING, day DATE, x DOUBLE, y DOUBLE")
    got = {(r.entity_id, r.day.day): r for r in density.dbscan(df, ["x", "y"], eps=0.95, min_samples=4).collect()}
    assert [got["a", i].cluster for i in range(1, 11)] == [0, 0, 0, 0, 0, 1, 1, 1, 1, -1]
    assert [got["b", i].cluster for i in (1, 2)] == [-1, -1] and got["b", 1].silhouette is None
    assert got["b", 1].distance == pytest.approx(4.0) and got["a", 10].distance == pytest.approx(40 - np.mean(at[5:9]))
    assert density.dbscan(df.limit(0), ["x", "y"]).count() == 0


def test_trees_are_whole_and_samples_bounded(spark):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i % 37), 1.0) for i in range(900)]
    df = spark.createDataFrame(rows, "entity_id STRING, day DATE, x DOUBLE, y DOUBLE")
    nodes = forest.grown_trees(df, ["x", "y"], trees=20, sample=64).toPandas()
    assert set(nodes.feature) == {-1, 0}  # y never varies
    for _, t in nodes.groupby("tree"):
        inner, places = t[t.feature >= 0], set(t.place)
        assert len(t) == 2 * len(inner) + 1 and {*inner.child, *(inner.child + 1), 1} == places
    again = forest.grown_trees(df.repartition(7), ["x", "y"], trees=20, sample=64).toPandas()
    key = ["tree", "place"]
    assert again.sort_values(key).reset_index(drop=True).equals(nodes.sort_values(key).reset_index(drop=True))
    flagged = forest.isolation_forest(df, ["x", "y"], trees=20, sample=64).agg(F.count_if("forest_anomaly").alias("n"), F.min("forest_score").alias("lo"), F.max("forest_score").alias("hi")).first()
    assert 0 < flagged.n <= 90 and (flagged.lo, flagged.hi) == (0.0, 1.0)


def test_exact_rank_sums_with_ties():
    """The dynamic programme against every choice of rows."""
    from itertools import combinations

    from nightloom.functions.tails import rank_sum_exact_p

    r = random.Random(4)
    for _ in range(20):
        n = r.randint(2, 9)
        values = sorted(r.randint(0, 4) for _ in range(n))
        n1 = r.randint(1, n - 1)
        groups = sorted(set(values))
        ties = [values.count(v) for v in groups]
        doubled = [2 * values.index(v) + t + 1 for v, t in zip(groups, ties)]
        rank = [doubled[groups.index(v)] for v in values]
        sums = [sum(rank[i] for i in pick) for pick in combinations(range(n), n1)]
        observed = r.choice(sums)
        want = np.mean([abs(s - n1 * (n + 1)) >= abs(observed - n1 * (n + 1)) for s in sums])
        assert rank_sum_exact_p(ties, doubled, n1, observed) == pytest.approx(want)
