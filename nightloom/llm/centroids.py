"""Centroid clustering in whole numbers, with PCA-rotated filtering.

The covariance of all vectors is summed in tasks (sums of outer products); its eigenvectors rotate the space.  With each
vector are stored its leading LEAD rotated coordinates and the length of what remains.  For a vector x and a centroid c

    |x - c|^2  >=  |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2

so one short matrix product bounds all centroids from below.  The centroid of the least bound is measured exactly; those
whose bound is not above that distance are measured exactly as well, in integers, and the nearest wins.  The bounds are
doubles and get a slack far above their rounding; they only choose what is measured, so any basis gives the same result.

Each round is one pass over the stored table.  Tasks give back a count and exact sums for each centroid (at most 40 rows
of 64 sums a task), which Spark adds up; the driver holds the 40 x 64 centroids and the 64 x 64 covariance, no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vectors as V
from ._shared import stored
from .registry import register, table

#: Rotated coordinates that are stored.
LEAD = 16
#: Slack of the bounds, as a share of the squared lengths that enter them.
SLACK = 1e-9
ROWS = 4096


def usable(vector: Column, width: int | None = None) -> Column:
    """Whether a vector has ``width`` components (any number if None), none of them null or non-finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fits = vector.isNotNull() & ~F.coalesce(odd, F.lit(False))
    return fits if width is None else fits & (F.size(vector) == width)


def _moments(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 + width + width * width)
    for batch in batches:
        x = V.whole(V.matrix(batch.column("vector"), width), scale)
        total[0] += len(x)
        total[1 : 1 + width] += x.sum(0)
        total[1 + width :] += (x.T @ x).ravel()
    if total[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "part"])


def basis_of(vectors: DataFrame, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and eigenvectors (columns, largest variance first) of all vectors; width + width**2 + 1 numbers come back."""
    parts = vectors.mapInArrow(partial(_moments, width=width, scale=scale), "at int, part double")
    total = np.zeros(1 + width + width * width)
    for at, part in parts.groupBy("at").agg(F.sum("part").alias("part")).collect():
        total[at] = part
    n = max(total[0], 1.0)
    mean = total[1 : 1 + width] / n
    spread = total[1 + width :].reshape(width, width) / n - np.outer(mean, mean)
    _, basis = np.linalg.eigh((spread + spread.T) / 2)
    return mean, basis[:, ::-1].copy()


def rotated(x: np.ndarray, mean: np.ndarray, basis: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates, and the length of the rest."""
    turned = (x - mean) @ basis
    return turned[:, :lead], V.lengths(turned[:, lead:])


def _stored_form(batches: Iterator[pa.RecordBatch], mean: np.ndarray, basis: np.ndarray, scale: int, lead: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = V.whole(V.matrix(batch.column("vector"), len(mean)), scale)
        front, rest = rotated(x, mean, basis, lead)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), V.longs(x), V.doubles(front), pa.array(rest)], ["vec_id", "whole", "front", "rest"]
        )


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of longs, exact; one that may not fit a long is an error."""
    gap = np.abs(x.astype(np.float64) - c)
    if len(gap) and float((gap * gap).sum(1).max()) >= 2.0**62:
        raise ValueError("squared distances of these vectors exceed a long")
    return ((x - c) ** 2).sum(1)


def nearest(x: np.ndarray, front: np.ndarray, rest: np.ndarray, centroids: np.ndarray, place: tuple[np.ndarray, np.ndarray], scratch: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to each row's nearest centroid; the smaller number wins a tie."""
    cf, cr = place
    own, other = (front * front).sum(1) + rest * rest, (cf * cf).sum(1) + cr * cr
    bound = own[:, None] + other[None, :] - 2 * (front @ cf.T) - 2 * rest[:, None] * cr[None, :]
    bound -= SLACK * (own[:, None] + other[None, :]) + 1e-6
    first = bound.argmin(1)
    best = _exact(x, centroids[first])
    row, number = np.nonzero(bound <= best[:, None])
    if scratch is not None:
        scratch.append((len(row), bound.size))
    far = _exact(x[row], centroids[number])
    order = np.lexsort((number, far, row))
    row, number, far = row[order], number[order], far[order]
    lead = np.ones(len(row), bool)
    lead[1:] = row[1:] != row[:-1]
    return number[lead], far[lead]


def _assigned(batches, centroids: np.ndarray, place, totals: bool) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, cluster, distance), or with ``totals`` one count and vector of sums for each centroid of the task."""
    count = np.zeros(len(centroids), np.int64)
    sums = np.zeros(centroids.shape, np.int64)
    width = centroids.shape[1]
    for whole_batch in batches:
        for lo in range(0, whole_batch.num_rows, ROWS):
            batch = whole_batch.slice(lo, ROWS)
            x = np.asarray(batch.column("whole").flatten()).reshape(-1, width)
            front = np.asarray(batch.column("front").flatten()).reshape(len(x), -1)
            cluster, far = nearest(x, front, np.asarray(batch.column("rest")), centroids, place)
            if not totals:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"]
                )
                continue
            count += np.bincount(cluster, minlength=len(centroids))
            np.add.at(sums, cluster, x)
    if totals and count.any():
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), V.longs(sums[some])], ["cluster", "n", "sums"])


def moved(centroids: np.ndarray, rows: DataFrame, place) -> np.ndarray:
    """Centroids after one round: exact floor of each cluster's mean; empty clusters keep theirs."""
    parts = rows.mapInArrow(partial(_assigned, centroids=centroids, place=place, totals=True), "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    total = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for cluster, at, n, value in total.collect():  # one number for each component of each centroid
        out[cluster, at] = int(value) // n
    return out


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", width: int = 64, scale: int = 256, lead: int = LEAD,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that takes part.

    Vectors with exactly ``width`` components, none null or non-finite, take part, each component as floor(scale * x).
    The first centroids are the ``k`` vectors of least sha256 of ``seed:vec_id`` (rows that share an id, and so a hash, go
    by their components; rows of null id never start a cluster unless there are fewer than ``k`` others).  With fewer
    vectors than ``k`` there are as many centroids as vectors; equal centroids are allowed, the smaller number wins every
    tie.  Repeated rows each count.  Null ids stay null.  Other columns are ignored, whatever their names; an empty
    table, or one where no vector takes part, gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    rows = rows.filter(usable(F.col("vector"), width))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(mark.asc_nulls_last(), "vec_id", "vector").limit(k).select("vector").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = V.whole(np.array([r.vector for r in first], np.float64), scale).astype(np.int64)
    mean, basis = basis_of(rows, width, scale)
    lead = min(lead, width)
    table_ = stored(
        rows.mapInArrow(
            partial(_stored_form, mean=mean, basis=basis, scale=scale, lead=lead), "vec_id long, whole array<long>, front array<double>, rest double"
        ),
        "centroid-vectors",
    )
    for _ in range(rounds):
        centroids = moved(centroids, table_, rotated(centroids.astype(np.float64), mean, basis, lead))
    place = rotated(centroids.astype(np.float64), mean, basis, lead)
    last = stored(
        table_.mapInArrow(partial(_assigned, centroids=centroids, place=place, totals=False), "vec_id long, cluster int, distance long"), "centroid-members"
    )
    inertia = {r.cluster: int(r.total) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    everything = sum(inertia.values())
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame(
        [(number, total, everything, names[number]) for number, total in sorted(inertia.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return last.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5) -> str:
    """Every round written out: all distances, the nearest, exact floors of means."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
          FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    seeds AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), vec_id, x) - 1 AS k, x AS c FROM v
              QUALIFY k < {k})"""
    ]
    centroid = "seeds"
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT row, vec_id, x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
        SELECT row, vec_id, x, k, list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS d FROM v, {centroid}) GROUP BY row, vec_id, x)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (SELECT k, pos, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT k, unnest(x) AS y, unnest(range(64)) AS pos FROM a{i}) GROUP BY k, pos),
    c{i} AS MATERIALIZED (SELECT p.k, coalesce(q.c, p.c) AS c FROM {centroid} p LEFT JOIN (
        SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS c FROM m{i} GROUP BY k) q ON p.k = q.k)"""
            )
            centroid = f"c{i}"
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
    FROM a{rounds} a JOIN {centroid} f ON a.k = f.k"""


@register("op12_centroid_clustering", _oracle())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))
