"""Exact top-k search by inner product as a Voronoi kNN join.

Largest inner products are nearest neighbours once every data vector x gets one more coordinate sqrt(M^2 - |x|^2), with
M the largest length, and every query a zero: |q - x|^2 = |q|^2 + M^2 - 2 q.x.  PIVOTS data vectors split that space into
Voronoi cells.  Summaries of the cells (largest distance of a cell's queries to their pivot; the k+1 least distances of a
cell's data to theirs) give each query cell i a radius that holds k+1 data vectors for every query in it:

    radius(i)  =  (k+1)-th least of  reach(i) + |p_i - p_j| + d(x, p_j)      over all cells j and their nearest data

By the triangle inequality a data vector x of cell j can be among the results of a query of cell i only if
d(x, p_j) >= |p_i - p_j| - reach(i) - radius(i).  Only those rows are sent to the group of i.  Neighbouring query cells
form a group; large groups are split into blocks of queries and each group's data into parts, so that no task holds more
than a block.  A task keeps the best k+1 of each of its queries, skips data that the same inequality rules out for all of
them, and scores the rest in whole numbers.  A window over the parts' winners gives the result.

Equal vectors are one class on either side: of a data class only the k+1 first rows can be in any result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _vectors as V
from ._shared import stored
from .centroids import usable
from .registry import register, table

#: Most Voronoi cells: a fixed bound, as tables of cells x cells are broadcast.
PIVOTS = 512
#: Queries in one block, and data rows in one part of a group.
BLOCK, PART = 256, 200_000
#: Slack of distances, as a share of the largest length.
SLACK = 1e-6
ROWS = 4096


class Cells:
    """Pivots of the extended space, and distances to them."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.longest = longest
        self.pivots = pivots
        self.extra = np.sqrt(np.maximum(longest**2 - (pivots * pivots).sum(1), 0))

    def distances(self, rows: np.ndarray, data: bool) -> np.ndarray:
        width = max(rows.shape[1], self.pivots.shape[1])
        rows, pivots = V.padded(rows, width), V.padded(self.pivots, width)
        own = (rows * rows).sum(1)
        extra = np.sqrt(np.maximum(self.longest**2 - own, 0)) if data else np.zeros(len(rows))
        own, other = own + extra**2, (pivots * pivots).sum(1) + self.extra**2
        inner = rows @ pivots.T + extra[:, None] * self.extra[None, :]
        return np.sqrt(np.maximum(own[:, None] + other[None, :] - 2 * inner, 0))

    def between(self) -> np.ndarray:
        return self.distances(self.pivots, True)


def _placed(batches: Iterator[pa.RecordBatch], cells: Cells, data: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            far = cells.distances(V.matrix(batch.column("vector")), data)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("own"), batch.column("tie"), batch.column("vector"), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])],
                ["own", "tie", "vector", "cell", "far"],
            )


def radii(cells: Cells, reach: dict[int, float], near: list[tuple[int, float]], most: int) -> dict[int, float]:
    """For each query cell a radius around any of its queries that holds ``most`` data vectors (infinite if too few)."""
    if len(near) < most:
        return dict.fromkeys(reach, math.inf)
    between = cells.between()
    cell = np.array([c for c, _ in near])
    far = np.array([d for _, d in near])
    # a query has no extra coordinate, so its distance to its pivot is part of reach
    return {i: r + float(np.partition(between[i, cell] + far, most - 1)[most - 1]) for i, r in reach.items()}


def grouped(cells: Cells, queries: dict[int, int], block: int) -> list[list[int]]:
    """Query cells in groups of about ``block`` queries, each of neighbouring cells."""
    between = cells.between()
    left = sorted(queries)
    groups: list[list[int]] = []
    while left:
        group = [left.pop(0)]
        size = queries[group[0]]
        while left and size < block:
            closest = min(left, key=lambda j: (between[group[0], j], j))
            if size + queries[closest] > block:
                break
            left.remove(closest)
            group.append(closest)
            size += queries[closest]
        groups.append(group)
    return groups


def reached(cells: Cells, groups: list[list[int]], reach: dict[int, float], radius: dict[int, float], widest: dict[int, float]) -> list[tuple[int, int, float]]:
    """(data cell, group, least distance to the pivot that a data row needs to be sent there)."""
    between = cells.between()
    slack = SLACK * max(1.0, cells.longest, *reach.values())
    out = []
    for g, group in enumerate(groups):
        least = np.min([between[i] - reach[i] - radius[i] for i in group], axis=0) - slack
        out += [(j, g, max(float(least[j]), 0.0)) for j, most in widest.items() if most >= least[j]]
    return out


class Best:
    """The best ``most`` classes of each query of a block, by score and then by the least id of their rows."""

    def __init__(self, queries: np.ndarray, most: int):
        self.queries, self.most = queries, most
        none = np.zeros(0, np.int64)
        self.score, self.tie, self.row = ([none] * len(queries) for _ in range(3))

    def floor(self) -> np.ndarray:
        """The score a candidate needs, minus infinity for queries with too few."""
        return np.array([float(s[-1]) if len(s) >= self.most else -math.inf for s in self.score])

    def add(self, data: np.ndarray, tie: np.ndarray, row: np.ndarray) -> None:
        width = max(self.queries.shape[1], data.shape[1])
        scores = V.products(V.padded(self.queries, width), V.padded(data, width))
        floor = self.floor()
        for i in np.flatnonzero(scores.max(1) >= floor):
            may = np.flatnonzero(scores[i] >= floor[i])
            if len(may) > 4 * self.most:  # of many, those that reach the block's own k-th score
                kth = np.partition(scores[i][may], len(may) - self.most)[len(may) - self.most]
                may = may[scores[i][may] >= kth]
            both = [np.concatenate([have[i], new[may]]) for have, new in ((self.score, scores[i]), (self.tie, tie), (self.row, row))]
            order = np.lexsort((both[2], both[1], -both[0]))[: self.most]
            self.score[i], self.tie[i], self.row[i] = (x[order] for x in both)


def _solved(batches: Iterator[pa.RecordBatch], cells: Cells, most: int) -> Iterator[pa.RecordBatch]:
    """Winners of each (group, block, part); its queries come first, its data by distance of their cells."""
    last, names, queries, best, far, length = None, [], [], None, None, None

    def winners() -> pa.RecordBatch:
        count = [len(s) for s in best.score]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(names, np.int64), count)), pa.array(np.concatenate(best.row)), pa.array(np.concatenate(best.score))],
            ["query", "class", "score"],
        )

    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            group = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("group", "block", "part")], 1)
            cut = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            for a, b in zip([0, *cut], [*cut, len(group)]):
                if last is None or (group[a] != last).any():
                    if best is not None:
                        yield winners()
                    last, names, queries, best = group[a].copy(), [], [], None
                piece = batch.slice(a, b - a)
                is_query = np.asarray(piece.column("is_query").to_numpy(zero_copy_only=False)).astype(bool)
                some = int(is_query.sum())  # queries are sorted to the front
                own = np.asarray(piece.column("own"))
                if some:
                    names += own[:some].tolist()
                    queries.append(V.matrix(piece.column("vector").slice(0, some)))
                if some == b - a or not names:
                    continue
                if best is None:
                    width = max(q.shape[1] for q in queries)
                    matrix = np.concatenate([V.padded(q, width) for q in queries])
                    best, far = Best(matrix, most), cells.distances(matrix, False)
                    length = (matrix * matrix).sum(1)
                data, own = piece.slice(some), own[some:]
                cell, at = np.asarray(data.column("cell")), np.asarray(data.column("far"))
                # distance within which a candidate reaches the score that a query needs
                need = np.sqrt(np.maximum(length + cells.longest**2 - 2 * best.floor(), 0)) + SLACK * max(1.0, cells.longest, float(np.sqrt(length.max())))
                outer, inner = np.full(len(cells.pivots), -math.inf), np.full(len(cells.pivots), math.inf)
                for j in np.unique(cell):
                    outer[j], inner[j] = (far[:, j] + need).max(), (far[:, j] - need).min()
                keep = np.flatnonzero((at <= outer[cell]) & (at >= inner[cell]))
                if len(keep):
                    best.add(V.matrix(data.column("vector").take(pa.array(keep))), np.asarray(data.column("tie"))[keep], own[keep])
    if best is not None:
        yield winners()


def top_k(
    vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100, pivots: int = PIVOTS, block: int = BLOCK, part: int = PART,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``every`` its k highest inner products.

    Components count as floor(scale * x).  Vectors that are null or hold a null or non-finite component take no part; a
    vector of fewer components than another counts as padded with zeros, an empty one scores 0 everywhere.  Candidates
    are all rows but the query's own, ties go to the smaller vec_id, null ids last; with fewer candidates than k there
    are fewer ranks.  Rows that share an id are rows of their own: each is a candidate of the other, and each is a query
    with its own ranks.  Other columns are ignored, whatever their names.  An empty table gives no rows.  Inner products
    that exceed a long are an error.
    """
    spark = vectors.sparkSession
    most = k + 1
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    rows = rows.filter(usable(F.col("vector"))).withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale)))
    rows = rows.withColumn("name", F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    # of equal vectors the first k+1 rows, in the order of results; partial limits run before the shuffle
    order = W.partitionBy("name").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    first = stored(rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most), "topk-first")
    tie = F.coalesce("vec_id", F.lit((1 << 63) - 1)).alias("tie")
    data = first.filter("at = 1").select(F.col("row").alias("own"), tie, "name", "vector")
    asked = rows.filter(F.col("vec_id") % every == 0)
    queries = asked.groupBy("name").agg(F.min("row").alias("own"), F.lit(0).cast("long").alias("tie"), F.first("vector").alias("vector"))
    empty = "query_id long, rank int, vec_id long, score long"
    sample = data.orderBy(F.xxhash64("name")).limit(pivots).select("vector").collect()  # a bounded sample of classes
    if not sample:
        return spark.createDataFrame([], empty)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n_data, longest = data.agg(F.count(F.lit(1)), F.max(length)).first()
    sample = sample[: max(1, math.isqrt(n_data))]
    width = max(len(r.vector) for r in sample)
    points = np.array([list(r.vector) + [0] * (width - len(r.vector)) for r in sample], np.float64).reshape(len(sample), width)
    cells = Cells(points, float(longest))
    form = "own long, tie long, vector array<long>, cell int, far double"
    data = stored(data.select("own", "tie", "vector").mapInArrow(partial(_placed, cells=cells, data=True), form), "topk-data")
    queries = stored(queries.select("own", "tie", "vector").mapInArrow(partial(_placed, cells=cells, data=False), form), "topk-queries")
    # summaries: at most k+1 rows and one for each cell
    asked_cells = {r.cell: r for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("reach")).collect()}
    if not asked_cells:
        return spark.createDataFrame([], empty)
    held = {r.cell: r for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("widest")).collect()}
    inside = W.partitionBy("cell").orderBy("far", "own")
    near = data.select("cell", "far", "own").withColumn("at", F.row_number().over(inside)).filter(F.col("at") <= most)
    near = [(r.cell, r.far) for r in near.select("cell", "far").collect()]
    reach = {c: r.reach for c, r in asked_cells.items()}
    groups = grouped(cells, {c: r.n for c, r in asked_cells.items()}, block)
    plan = reached(cells, groups, reach, radii(cells, reach, near, most), {c: r.widest for c, r in held.items()})
    between = cells.between()
    blocks = [max(1, math.ceil(sum(asked_cells[c].n for c in g) / block)) for g in groups]
    sent = [sum(held[j].n for j, g, _ in plan if g == n) for n in range(len(groups))]
    parts = [max(1, math.ceil(x / part)) for x in sent]
    # both tables are bounded by the number of cells (its square, at most 512 x 512)
    where = spark.createDataFrame(
        [(j, g, least, float(min(between[i, j] for i in groups[g])), blocks[g], parts[g]) for j, g, least in plan],
        "cell int, group int, least double, near double, blocks int, parts int",
    )
    homes = spark.createDataFrame([(c, g, blocks[g], parts[g]) for g, group in enumerate(groups) for c in group], "cell int, group int, blocks int, parts int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda n: F.pmod(F.xxhash64("own"), F.col(n)).cast("int")
    ask = queries.join(F.broadcast(homes), "cell").select(
        "group", some("blocks").alias("block"), every_of("parts").alias("part"), F.lit(True).alias("is_query"), F.lit(-1.0).alias("near"), "cell", "far", "own", "tie", "vector"
    )
    give = data.join(F.broadcast(where), "cell").filter("far >= least").withColumn("part", some("parts"))
    give = give.select("group", every_of("blocks").alias("block"), "part", F.lit(False).alias("is_query"), "near", "cell", "far", "own", "tie", "vector")
    met = ask.unionByName(give).repartition("group", "block", "part").sortWithinPartitions("group", "block", "part", F.desc("is_query"), "near", "own")
    met = met.select("group", "block", "part", "is_query", "cell", "far", "own", "tie", "vector")
    won = met.mapInArrow(partial(_solved, cells=cells, most=most), "query long, class long, score long")
    # classes become rows, each query drops its own; a class gives k+1 rows at most
    names = rows.select(F.col("row"), "name")
    won = won.join(first.filter("at = 1").select(F.col("row").alias("class"), "name"), "class").select("query", "score", "name")
    won = won.join(first.select("name", "vec_id", F.col("row").alias("found")), "name").select("query", "score", "vec_id", "found")
    ranked = W.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "found")
    won = won.withColumn("at", F.row_number().over(ranked)).filter(F.col("at") <= most)
    answers = stored(
        won.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("at", "score", "vec_id", "found"))).alias("best"))
        .join(names.withColumnRenamed("row", "query"), "query").select("name", "best"),
        "topk-answers",
    )
    mine = asked.select("name", F.col("vec_id").alias("query_id"), F.col("row").alias("own")).join(answers, "name")
    mine = mine.withColumn("best", F.slice(F.filter("best", lambda b: b["found"] != F.col("own")), 1, k))
    return mine.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")
    )


@register(
    "op11_topk_search",
    """
    WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
          FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 100 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 10
    """,
)
def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
