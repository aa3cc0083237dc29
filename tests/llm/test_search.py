"""Top-k search and clustering against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from nightloom.llm import _vectors as V
from nightloom.llm.centroids import _exact, basis_of, cluster, nearest, rotated
from nightloom.llm.topk import top_k

FORM = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def frame(spark, rows, clash=False):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], FORM).repartition(3)
    return df.selectExpr("*", *(f"1 AS {c}" for c in ("own", "cell", "far", "row", "name", "score", "cluster", "distance", "front"))) if clash else df


def floors(v, scale):
    return [math.floor(float(np.float32(x)) * scale) for x in v]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def top_brute(rows, k, scale, every):
    have = [(i, floors(v, scale)) for i, v in rows if fine(v)]
    out = []
    for a, (q, x) in enumerate(have):
        if q is None or q % every:
            continue
        best = sorted((-sum(s * t for s, t in zip(x, y)), c is None, c or 0) for b, (c, y) in enumerate(have) if b != a)
        out += [(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(best[:k])]
    return sorted(out, key=repr)


def points(seed, n, width=6, centres=7):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(width)] for _ in range(centres)]
    out = [(i, [x + r.gauss(0, 0.05) for x in r.choice(middle)]) for i in range(n)]
    out += [(n + i, [0.5] * width) for i in range(40)]  # equal vectors, hence ties
    out += [(n + 40, None), (n + 41, [0.1, None] + [0.0] * (width - 2)), (n + 42, [float("nan")] * width), (n + 43, [float("inf")] + [0.0] * (width - 1))]
    out += [(0, [0.25] * width), (None, [0.25] * width), (n + 44, [0.0] * width), (n + 45, []), (n + 46, [9.0, -9.0])]
    return out


@pytest.mark.parametrize("seed,block,part,pivots", [(1, 8, 50, 16), (2, 3, 10_000, 40), (3, 256, 200_000, 512)])
def test_top_k(spark, seed, block, part, pivots):
    rows = points(seed, 300)
    got = top_k(frame(spark, rows, clash=True), k=5, every=4, block=block, part=part, pivots=pivots)
    assert sorted(map(tuple, got.collect()), key=repr) == top_brute(rows, 5, 1024, 4)


def test_top_k_small_tables(spark):
    assert top_k(frame(spark, [])).collect() == []
    assert top_k(frame(spark, [(0, None), (100, [float("nan")])])).collect() == []
    assert top_k(frame(spark, [(0, [1.0])])).collect() == []
    few = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (5, [1.0, 2.0]), (200, [-1.0, 0.0])]
    assert sorted(map(tuple, top_k(frame(spark, few)).collect())) == sorted(top_brute(few, 10, 1024, 100))


def test_top_k_many_equal_scores(spark):
    """More classes of equal score than results: the smaller ids win, wherever their cells lie."""
    r = random.Random(5)
    ids = list(range(1, 200))
    r.shuffle(ids)
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, r.uniform(-3, 3), r.uniform(-3, 3)]) for i in ids]
    got = top_k(frame(spark, rows), k=10, pivots=30, part=20)
    assert sorted(map(tuple, got.collect()), key=repr) == top_brute(rows, 10, 1024, 100)


def test_products_stay_exact():
    big = np.array([[2.0**30 + 1, 1.0]])
    assert V.products(big, big)[0, 0] == (2**30 + 1) ** 2 + 1
    with pytest.raises(ValueError):
        V.products(big * 2**10, big * 2**10)


def cluster_brute(rows, k, rounds, width):
    have = [(i, floors(v, 256)) for i, v in rows if fine(v) and len(v) == width]
    mark = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    seeds = sorted(have, key=lambda p: (p[0] is None, mark(p[0]), p[0] or 0, p[1]))
    centroids = [list(v) for _, v in seeds[:k]]
    for step in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in have]
        if step < rounds:
            for n in range(len(centroids)):
                members = [v for (_, v), (_, m) in zip(have, own) if m == n]
                if members:
                    centroids[n] = [sum(x) // len(members) for x in zip(*members)]
    total = {}
    for d, n in own:
        total[n] = total.get(n, 0) + d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, total[n], sum(total.values()), name[n]) for (i, _), (d, n) in zip(have, own)), key=repr)


@pytest.mark.parametrize("seed,k,lead", [(1, 9, 2), (2, 20, 6), (3, 500, 1)])
def test_cluster(spark, seed, k, lead):
    rows = points(seed, 200)
    got = cluster(frame(spark, rows, clash=True), k=k, rounds=4, width=6, lead=lead)
    assert sorted(map(tuple, got.collect()), key=repr) == cluster_brute(rows, k, 4, 6)


def test_cluster_small_tables(spark):
    assert cluster(frame(spark, [])).collect() == []
    assert cluster(frame(spark, [(1, [1.0] * 63), (2, None)])).collect() == []
    one = [(7, [0.5] * 64), (7, [0.5] * 64), (None, [-0.3] * 64)]
    assert sorted(map(tuple, cluster(frame(spark, one)).collect()), key=repr) == cluster_brute(one, 40, 5, 64)


def test_bounds_leave_few_centroids():
    """The filter leaves out centroids, and what it leaves in decides as a full comparison does."""
    r = np.random.default_rng(1)
    middle = r.normal(0, 200, (40, 64))
    x = np.floor(middle[r.integers(0, 40, 3000)] + r.normal(0, 10, (3000, 64)))
    centroids = np.floor(middle).astype(np.int64)
    spread = np.cov(x.T)
    basis = np.linalg.eigh(spread)[1][:, ::-1]
    front, rest = rotated(x, x.mean(0), basis, 16)
    seen = []
    number, far = nearest(x.astype(np.int64), front, rest, centroids, rotated(centroids.astype(float), x.mean(0), basis, 16), seen)
    every = ((x.astype(np.int64)[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (far == every.min(1)).all()
    assert seen[0][0] < 0.2 * seen[0][1]


def test_basis_is_that_of_the_covariance(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1 + c) for c in range(5)]) for i in range(400)]
    mean, basis = basis_of(frame(spark, rows).selectExpr("cast(embedding as array<double>) vector"), 5, 256)
    x = np.array([floors(v, 256) for _, v in rows], float)
    assert np.allclose(mean, x.mean(0))
    turned = np.cov(x.T, bias=True)
    assert np.allclose(basis.T @ turned @ basis, np.diag(np.linalg.eigvalsh(turned)[::-1]), atol=1e-3 * np.abs(turned).max())
    with pytest.raises(ValueError):
        _exact(np.full((1, 2), 2**40), np.zeros((1, 2), np.int64))
