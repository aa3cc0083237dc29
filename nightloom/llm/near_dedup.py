"""Near-duplicate detection by a chosen-path set similarity join.

Documents are sets of word shingles.  Independent trees branch them by minwise tokens: at every node a document goes to
BRANCHES children, named by the least of its tokens under that child's order.  Nodes of one document end; small nodes
are compared exhaustively inside their task; larger ones branch again.  With two branches a pair of similarity 0.8 meets in a tree with
probability of at least 0.9375 whatever the depth, so the number of trees follows from the wanted recall.

After LEVELS a node that is still large is also cut into blocks that share its first document, which connects groups of
mutual near-copies.  Of a block only its parts are looked up in the clusters, as what a block connects is in one.  From
there on only what is not connected yet matters: a node whose documents are all connected ends; one with few documents outside its commonest component compares those with all its blocks; one with many
branches again, down to DEEPEST levels, where whatever is left is compared.  So every pair of a node where branching
ends is compared or connected otherwise, and a node that several trees hold is compared once.

Inside a node, sketches (bytes of SKETCH minwise tokens) leave pairs that can reach the threshold at seven standard
deviations; only what they connect leaves the task, as stars of one row for each document, so nodes never list their pairs.  The
stars of all nodes make clusters, and every link lies within one.  Clusters are confirmed on full sets, in blocks of bounded size: first
each block with some documents that all blocks of a cluster share, then what is not in a cluster's commonest component
against all its blocks.  Again a task gives back stars of what its links connect, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as T
from ._shared import cut as kept_rows
from ._shared import has_rows, keyed_rows, stored
from .registry import register, table

#: The many small tables; those with long arrays are checkpoints, which need no column buffers.
cut = partial(stored, name="near-dedup")

LEVELS, DEEPEST, BRANCHES, SKETCH = 3, 7, 2, 128
#: Levels that a large node branches at once before it is looked at again.
STRIDE = 2
#: Chance that a pair at the threshold is missed by all trees.
MISS = 1e-9
#: Documents in a node that is compared as it is.
SMALL = 64
#: Documents of a cluster in one block, and about how many of them all blocks share.
BLOCK, SHARED = 512, 16
#: So many documents outside the commonest component are compared with the whole node; with more, it branches.
FEW = BLOCK
#: Links that one task joins, after the others have been contracted.
WALK = 1 << 17
#: Bits of the map of documents in clusters that every task gets.
BITS = 1 << 26
#: Columns of the incidence matrix that is multiplied at once.
COLUMNS = 4096


def trees_for(share: float, miss: float = MISS) -> int:
    """Trees so that a pair of similarity ``share`` is missed by all of them with chance ``miss`` at most."""
    meet = 1.0
    for _ in range(DEEPEST):
        meet = 1 - (1 - share * meet) ** BRANCHES
    return max(1, math.ceil(math.log(miss) / math.log(1 - meet)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and name of each row's different shingles, sorted; a row of fewer words than ``width`` has one, if any."""
    starts, ends, rows = T.words(data, offsets)
    lower = T.LOWER[data]
    names = T.word_hashes(lower, starts, ends)
    n_words = np.diff(rows)
    count = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(len(count)), count)
    first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + rows[:-1][row]
    size = np.minimum(width, n_words)[row]
    shingle = T.sequences(names, first, size)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    return row[new], shingle[new]


def orders(trees: int) -> list[int]:
    """Multipliers of the orders: one for each branch of each level of each tree, and as many as a sketch needs."""
    count = max(SKETCH, trees * DEEPEST * BRANCHES)
    return (T.mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)).tolist()


def _signatures(batches: Iterator[pa.RecordBatch], width: int, multipliers: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in T.slices(batch, "text"):
            row, shingle = shingle_sets(data, offsets, width)
            n = np.bincount(row, minlength=hi - lo)
            some = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[some]
            least = np.zeros((hi - lo, len(multipliers)), np.uint32)
            one, two = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
            if len(some):
                for k, order in enumerate(multipliers):
                    least[some, k] = np.minimum.reduceat(shingle * np.uint64(order), first) >> np.uint64(32)
                one[some] = np.add.reduceat(shingle, first)
                two[some] = np.add.reduceat(T.mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), first)
            tokens = pa.FixedSizeListArray.from_arrays(pa.array(least.view(np.int32).ravel()), len(multipliers)).cast(pa.list_(pa.int32()))
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [own.column("rid"), own.column("own_id"), pa.array(n.astype(np.int64)), T.longs(one), T.longs(two), tokens],
                ["rid", "own_id", "n", "a", "b", "tokens"],
            )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in T.slices(batch, "text"):
            row, shingle = shingle_sets(data, offsets, width)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
            own = batch.slice(lo, hi - lo)
            sets = pa.ListArray.from_arrays(pa.array(ends), T.longs(shingle))
            yield pa.RecordBatch.from_arrays([own.column("rid"), own.column("path"), sets], ["rid", "path", "set"])


def least_agreement(share: float) -> int:
    """Equal minwise tokens that a pair at the threshold has but for chances of about one in 10**11."""
    return max(1, math.floor(SKETCH * share - 7 * math.sqrt(SKETCH * share * (1 - share))))


class Forest:
    """Union-find over the rows of one task's group."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)
        return x != y


def _once(rows: list[tuple]) -> list[tuple]:
    """Rows by rid; one that came in twice, as a document that all blocks share does, counts once."""
    return sorted({r[0]: r for r in rows}.values(), key=lambda r: r[0])


def _tops(rows: list[tuple], percent: int) -> list[int]:
    """Of every row the first one that pairs which may be links connect it with; rows: (rid, n, sketch, ...) by rid."""
    if len(rows) < 2:
        return [0] * len(rows)
    n = np.array([r[1] for r in rows])
    sketch = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), SKETCH)
    least = least_agreement(percent / 100)
    found = []
    for i in range(len(rows) - 1):
        same = (sketch[i + 1 :] == sketch[i]).sum(1)
        lo, hi = np.minimum(n[i], n[i + 1 :]), np.maximum(n[i], n[i + 1 :])
        found += [(i, i + 1 + int(j)) for j in np.flatnonzero((same >= least) & (100 * lo >= percent * hi))]
    forest = Forest(len(rows))
    for i, j in found:
        forest.join(i, j)
    return [forest.find(i) for i in range(len(rows))]


def _node(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """What a node's pairs that may be links connect, as stars around least ids; rows: (rid, n, sketch)."""
    rows = _once(rows)
    return [(rows[top][0], rows[i][0]) for i, top in enumerate(_tops(rows, percent)) if top != i]


def _block(rows: list[tuple], percent: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """The stars of _node, and (part, size, x, y) of every part that has counted rows: its least rid, their number and
    two sums of their marks; rows: (rid, n, sketch, counted)."""
    rows = _once(rows)
    tops = np.array(_tops(rows, percent), np.int64)
    counted = np.array([r[3] for r in rows], bool)
    mark = T.mix(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    parts = []
    for top in np.unique(tops[counted]).tolist():
        own = mark[counted & (tops == top)]
        parts.append((rows[top][0], len(own), int(np.bitwise_xor.reduce(own).view(np.int64)), int((own >> np.uint64(24)).sum())))
    return [(rows[top][0], rows[i][0]) for i, top in enumerate(tops.tolist()) if top != i], parts


def _strays(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """What the pairs of strays with rows of other parts connect, as stars of one row of each part; rows: (rid, n,
    sketch, part, stray)."""
    rows = _once(rows)
    if len(rows) < 2:
        return []
    n = np.array([r[1] for r in rows])
    sketch = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), SKETCH)
    part = np.array([r[3] for r in rows])
    least = least_agreement(percent / 100)
    forest = Forest(len(rows))
    at: dict[int, int] = {}
    for i, r in enumerate(rows):
        forest.join(at.setdefault(r[3], i), i)
    for i in [i for i, r in enumerate(rows) if r[4]]:
        may = np.flatnonzero((part != part[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        for j in may[(sketch[may] == sketch[i]).sum(1) >= least].tolist():
            forest.join(i, j)
    return [(rows[forest.find(i)][0], rows[i][0]) for i in at.values() if forest.find(i) != i]


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of the incidence matrix, some columns at a time."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # tokens of one set only add nothing between two
    keep = count[token] > 1
    row, token = row[keep], column[token[keep]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        a, b = np.searchsorted(token, [lo, lo + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(token[-1]) + 1 - lo)), np.float32)
        part[row[a:b], token[a:b] - lo] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _linked(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """What a block's links connect, as stars of one row of each part; rows: (rid, set, part)."""
    rows = _once(rows)
    if len(rows) < 2:
        return []
    sets = [r[1] for r in rows]
    size = np.array([len(x) for x in sets])
    both = intersections(sets)
    first, second = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
    forest = Forest(len(rows))
    at: dict[int, int] = {}
    for i, r in enumerate(rows):
        forest.join(at.setdefault(r[2], i), i)
    for i, j in zip(first.tolist(), second.tolist()):
        forest.join(i, j)
    return [(rows[forest.find(i)][0], rows[i][0]) for i in at.values() if forest.find(i) != i]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Path and rows of each (path, block); rows come sorted by those, and a group's number is bounded."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        columns = []
        for c in batch.columns:
            if pa.types.is_list(c.type):
                ends, flat = np.asarray(c.offsets), c.values.to_numpy()
                columns.append([flat[a:b].copy() for a, b in zip(ends[:-1], ends[1:])])
            else:
                columns.append(c.to_pylist())
        for path, block, *row in zip(*columns):
            if (path, block) != last:
                if held:
                    yield last[0], held
                held, last = [], (path, block)
            held.append(tuple(row))
    if held:
        yield last[0], held


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def _by_group(batches: Iterator[pa.RecordBatch], pairs_of, percent: int) -> Iterator[pa.RecordBatch]:
    """Calls pairs_of on the rows of each group."""
    pairs: set[tuple[int, int]] = set()
    for _, held in _groups(batches):
        pairs.update(pairs_of(held, percent))
        if len(pairs) > 50_000:
            yield _batch(sorted(pairs), ["u", "v"])
            pairs.clear()
    if pairs:
        yield _batch(sorted(pairs), ["u", "v"])


def _by_block(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Calls _block on the rows of each group: pairs have no path, parts have their rid as u and v."""
    names = ["u", "v", "path", "size", "x", "y"]
    pairs: set[tuple[int, int]] = set()
    parts: list[tuple] = []
    rows = lambda: [(u, v, None, None, None, None) for u, v in sorted(pairs)] + parts
    for path, held in _groups(batches):
        some, own = _block(held, percent)
        pairs.update(some)
        parts += [(part, part, path, size, x, y) for part, size, x, y in own]
        if len(pairs) + len(parts) > 50_000:
            yield _batch(rows(), names)
            pairs.clear()
            parts.clear()
    if pairs or parts:
        yield _batch(rows(), names)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("path", "block").sortWithinPartitions("path", "block")


def _within(rows: DataFrame, pairs_of, percent: int) -> DataFrame:
    """Pairs (u, v), u < v, that pairs_of finds in each (path, block); the other columns are its rows."""
    return _dealt(rows).mapInArrow(partial(_by_group, pairs_of=pairs_of, percent=percent), "u long, v long").distinct()


def in_blocks(nodes: DataFrame, sketch: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v), u < v, of all blocks of nodes, and (path, part, size, x, y) of the large ones' parts.

    All blocks of a large node share its first document, whose part so has one row whatever the number of blocks.
    """
    leaders = nodes.filter("blocks > 1").groupBy("path", "blocks").agg(F.min("rid").alias("rid"))
    spread = leaders.select("path", "rid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("counted"), "blocks")
    spread = spread.filter(F.col("block") != block_of("rid", "blocks")).drop("blocks")
    placed = nodes.select("path", "block", "rid", (F.col("blocks") > 1).alias("counted")).unionByName(spread)
    dealt = _dealt(placed.join(sketch, "rid").select("path", "block", "rid", "n", "sketch", "counted"))
    found = cut(dealt.mapInArrow(partial(_by_block, percent=percent), "u long, v long, path long, size long, x long, y long"))
    parts = found.filter("path is not null").groupBy("path", F.col("u").alias("part"))
    return found.filter("path is null").select("u", "v").distinct(), cut(parts.agg(F.sum("size").alias("size"), F.bit_xor("x").alias("x"), F.sum("y").alias("y")))


def block_of(rid: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(rid), F.col(blocks)).cast("int")


def level_tokens(level: int, stride: int) -> Column:
    """Of the tokens those of ``stride`` levels, tree by tree: what a join has to carry."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size("tokens") / (DEEPEST * BRANCHES)).cast("int") - 1), lambda tree: F.slice("tokens", tree * (DEEPEST * BRANCHES) + level * BRANCHES + 1, stride * BRANCHES)))


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose rid is one of keys, and few others: a map of BITS bits, whatever the input, spares others the exchange.

    The join that follows is what decides.
    """
    word = lambda: F.pmod(F.xxhash64("rid"), F.lit(BITS // 64))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(rid, 3), 64) as int))")
    bits = keys.select(word().alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.withColumn("word", word()).join(F.broadcast(bits), "word").filter(F.col("bits").bitwiseAND(bit) != 0).select(rows.columns)


def branched(rows: DataFrame, groups: DataFrame, level: int, stride: int = 1) -> DataFrame:
    """Descendants, ``stride`` levels down, with two documents or more of the nodes of rows (path, tree, rid, maybe part):
    path, tree, rid, part if given, m (documents)."""
    own = [c for c in ("rid", "tree", "part") if c in rows.columns]
    if "tokens" not in rows.columns:
        rows = rows.select(*own, "path").join(groups.select("rid", level_tokens(level, stride).alias("tokens")), "rid")
    else:
        rows = rows.withColumn("tokens", level_tokens(level, stride))
    token = lambda i, j: F.get("tokens", F.col("tree") * (stride * BRANCHES) + i * BRANCHES + j)
    ways = [F.struct(*(F.struct(F.lit(j).alias("j"), token(i, j).alias("t")).alias(f"c{i}") for i, j in enumerate(way))) for way in product(range(BRANCHES), repeat=stride)]
    rows = rows.withColumn("c", F.explode(F.array(*ways))).select(*own, F.xxhash64("path", "tree", "c").alias("path"))
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    return rows.join(sizes, "path")


def tree_nodes(groups: DataFrame, trees: int) -> DataFrame:
    """Nodes with two documents or more after LEVELS, or small before: path, tree, rid, m, blocks, block.

    A small node is one block.  A larger one has blocks by hash.
    """
    done = []
    rows = groups.select("rid", "tokens").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("path", F.lit(0).cast("long"))
    for level in range(LEVELS):
        rows = cut(branched(rows, groups, level))
        last = level == LEVELS - 1
        done.append(rows if last else rows.filter(F.col("m") <= SMALL))
        large = rows.filter(F.col("m") > SMALL)
        if last or not has_rows(large):
            break
        rows = large
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    blocks = F.when(F.col("m") <= SMALL, 1).otherwise(F.ceil(F.col("m") / (SMALL // 2))).cast("int")
    return every.withColumn("blocks", blocks).withColumn("block", block_of("rid", "blocks"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, label of the ends of the few links that are left, by union-find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    if root:
        rid = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array([find(x) for x in rid], pa.int64())], ["rid", "label"])


def components(links: DataFrame) -> DataFrame:
    """rid, label: the least rid reachable, for every end of a link.

    Each round every vertex goes to its least neighbour, and that one's least neighbour, if they are less; links between what
    has become one go, so they shrink geometrically.  The last WALK links, a fixed number, are joined in one task.
    """
    edges = cut(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct())
    rounds: list[DataFrame] = []
    while edges.count() > WALK:
        ways = edges.union(edges.select("v", "u")).toDF("rid", "other")
        least = cut(ways.groupBy("rid").agg(F.least("rid", F.min("other")).alias("up")))
        parent = cut(least.join(least.select(F.col("rid").alias("up"), F.col("up").alias("top")), "up").select("rid", F.col("top").alias("up")))
        rounds.append(parent)
        end = lambda c: parent.select(F.col("rid").alias(c), F.col("up").alias(f"{c}_up"))
        moved = edges.join(end("u"), "u").join(end("v"), "v").select(F.least("u_up", "v_up").alias("u"), F.greatest("u_up", "v_up").alias("v"))
        edges = cut(moved.filter("u <> v").distinct())
    labels = cut(edges.repartition(1).mapInArrow(_joined, "rid long, label long"))
    for parent in reversed(rounds):
        labels = cut(parent.join(labels.withColumnRenamed("rid", "up"), "up", "left").select("rid", F.coalesce("label", "up").alias("label")))
    return labels


def open_nodes(parts: DataFrame) -> DataFrame:
    """path, common, m, strays of the nodes whose documents lie in several parts; parts: path, part, size, x, y.

    Of equal nodes that are compared next one stays; those that branch on all do, as each tree is a chance of its own.
    """
    nodes = parts.groupBy("path").agg(F.max(F.struct("size", "part")).alias("top"), F.sum("size").alias("m"), F.bit_xor("x").alias("x"), F.sum("y").alias("y"))
    on = F.when(F.col("m") - F.col("top.size") > FEW, F.col("path")).alias("on")
    nodes = nodes.filter("m > top.size").groupBy("m", "x", "y", on).agg(F.min("path").alias("path"), F.min_by("top", "path").alias("top"))
    return nodes.select("path", F.col("top.part").alias("common"), "m", (F.col("m") - F.col("top.size")).alias("strays"))


def clustered(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """Parts (path, part, size, x, y) of blocks, put together by the cluster that their first documents are in."""
    named = parts.join(labels.withColumnRenamed("rid", "part"), "part", "left").withColumn("part", F.coalesce("label", "part"))
    return named.groupBy("path", "part").agg(F.sum("size").alias("size"), F.bit_xor("x").alias("x"), F.sum("y").alias("y"))


def parts_of(member: DataFrame) -> DataFrame:
    """path, part, size, x, y of the nodes of member (path, rid, part)."""
    mark = F.xxhash64("rid")
    return member.groupBy("path", "part").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 24)).alias("y"))


def among_strays(member: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that connect parts of the nodes of member (path, rid, part, common, m, strays).

    A group is one block of a node and one chunk of its documents outside the commonest component.
    """
    member = (
        member.withColumn("stray", F.col("part") != F.col("common"))
        .withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("chunks", F.ceil(F.col("strays") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(2)), F.col("chunks")).cast("int"))
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at_blocks = member.filter("stray").select("path", "rid", "part", "stray", "chunks", "chunk", every("blocks").alias("block"))
    at_chunks = member.select("path", "rid", "part", "stray", "chunks", every("chunks").alias("chunk"), "block")
    group = (F.col("block").cast("long") * F.col("chunks") + F.col("chunk")).alias("block")
    groups = at_blocks.unionByName(at_chunks).select("path", group, "rid", "part", "stray").distinct()
    return _within(groups.join(sketch, "rid").select("path", "block", "rid", "n", "sketch", "part", "stray"), _strays, percent)


def apart(large: DataFrame, near: DataFrame, parts: DataFrame, groups: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Clusters (rid, label): those of near and of what large nodes (path, tree, rid) hold beyond them.

    parts: the large nodes' path, part, size, x, y, as near connects them in blocks.  Only the documents of nodes that are
    left open are looked up one by one, and their children keep what was found.
    """
    clusters = components(near)
    found = []
    for level in range(LEVELS, DEEPEST + 1, STRIDE):
        if level == LEVELS:
            member = large.join(open_nodes(clustered(parts, clusters)), "path").join(clusters, "rid", "left")
            member = cut(member.withColumn("part", F.coalesce("label", "rid")).drop("label"))
        else:
            member = cut(large.join(open_nodes(parts_of(large)), "path"))
        if not has_rows(member):
            break
        many = member.filter((F.col("strays") > FEW) & F.lit(level < DEEPEST))
        found.append(cut(among_strays(member.filter((F.col("strays") <= FEW) | F.lit(level == DEEPEST)), sketch, percent)))
        if not has_rows(many):
            break
        children = cut(branched(many, groups, level, STRIDE))
        small = children.filter(F.col("m") <= SMALL).select("path", F.lit(0).alias("block"), "rid").join(sketch, "rid")
        found.append(cut(_within(small.select("path", "block", "rid", "n", "sketch"), _node, percent)))
        large = children.filter(F.col("m") > SMALL).drop("m")
    if not found:
        return clusters
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    # found pairs join whole clusters: their ends stand for them
    name = lambda end: clusters.select(F.col("rid").alias(end), F.col("label").alias(f"{end}_of"))
    between = links.join(name("u"), "u", "left").join(name("v"), "v", "left").select(F.coalesce("u_of", "u").alias("u"), F.coalesce("v_of", "v").alias("v"))
    between = cut(between.filter("u <> v").distinct())
    if not has_rows(between):
        return clusters
    joined = components(between)
    moved = clusters.join(joined.select(F.col("rid").alias("label"), F.col("label").alias("new")), "label", "left").select("rid", F.coalesce("new", "label").alias("label"))
    return cut(moved.unionByName(joined.join(clusters.select("rid"), "rid", "left_anti")))


def confirmed(sets: DataFrame, percent: int) -> DataFrame:
    """rid, label of the components that the links in clusters make; sets: rid, path (the cluster), set."""
    sizes = sets.groupBy("path").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BLOCK)
    large = cut(
        sets.select("path", "rid").join(sizes, "path").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    )
    if not has_rows(large):
        own = sets.select("path", F.lit(0).alias("block"), "rid", "set", F.col("rid").alias("part"))
        return components(cut(_within(own, _linked, percent)))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    to_all = large.filter(F.pmod(F.xxhash64("rid", F.lit(1)), F.ceil(F.col("m") / SHARED)) == 0)
    placed = large.select("rid", "block").unionByName(to_all.select("rid", every)).distinct()
    own = sets.join(placed, "rid", "left").select("path", F.coalesce("block", F.lit(0)).alias("block"), "rid", "set", F.col("rid").alias("part"))
    links = cut(_within(own, _linked, percent))
    labels = components(links)
    member = cut(large.join(labels, "rid", "left").select("path", "rid", "block", "blocks", F.coalesce("label", "rid").alias("part")))
    parts = member.groupBy("path", "part").agg(F.count(F.lit(1)).alias("size"))
    common = parts.groupBy("path").agg(F.max(F.struct("size", "part")).alias("top"), F.sum("size").alias("m"))
    rest = common.select("path", F.col("top.part").alias("common"), F.ceil((F.col("m") - F.col("top.size")) / BLOCK).cast("int").alias("chunks"))
    member = member.join(rest.filter("chunks > 0"), "path")
    # a group is one block of the cluster and one chunk of the rows outside its commonest component
    stray = member.filter("part <> common").withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(2)), F.col("chunks")).cast("int"))
    at_blocks = stray.select("path", "rid", "part", "chunks", "chunk", every)
    at_chunks = member.select("path", "rid", "part", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block")
    groups = at_blocks.unionByName(at_chunks).select("path", (F.col("block") * F.col("chunks") + F.col("chunk")).alias("block"), "rid", "part")
    more = cut(_within(groups.join(sets.select("rid", "set"), "rid").select("path", "block", "rid", "set", "part"), _linked, percent))
    return components(links.unionByName(more)) if has_rows(more) else labels


def near_dedup(docs: DataFrame, width: int = 2, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each input row.

    Words are lower-cased (A-Z) runs of other bytes than space and 9 to 13; a row's set is its different ``width``-word
    shingles, with fewer words the whole sequence as one.  Rows are linked if 100 * intersection >= percent * union.
    component_id is the least doc_id reachable.  Null and empty texts, and texts of separators only, have size 0 and are
    linked with nothing.  Equal sets, so repeated rows too, are one vertex.  Rows that share a doc_id are apart unless
    linked; a null id counts for links but is never a component's id, and a component of null ids only has none; all rows
    with their component's id are kept.  Texts are read whole; other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    rows, own_id = keyed_rows(docs, doc_id, text)
    trees = trees_for(percent / 100)
    signed = kept_rows(
        rows.select("rid", own_id.alias("own_id"), "text").mapInArrow(
            partial(_signatures, width=width, multipliers=orders(trees)), "rid long, own_id long, n long, a long, b long, tokens array<int>"
        )
    )
    full = signed.filter("n > 0")
    groups = kept_rows(full.groupBy("a", "b", "n").agg(F.min("rid").alias("rid"), F.first("tokens").alias("tokens")))
    nodes = cut(tree_nodes(groups, trees))
    sketch = groups.select("rid", "n", _sketch("tokens").alias("sketch"))
    near, parts = in_blocks(nodes, sketch, percent)
    clusters = apart(nodes.filter("blocks > 1").select("path", "tree", "rid"), near, parts, groups, sketch, percent)
    sets = kept_rows(
        among(rows.select("rid", "text"), clusters).join(clusters.withColumnRenamed("label", "path"), "rid")
        .mapInArrow(partial(_sets, width=width), "rid long, path long, set array<long>")
    )
    labels = confirmed(sets, percent)
    vertex = (
        groups.select("a", "b", "n", "rid").join(labels, "rid", "left")
        .select("a", "b", "n", F.coalesce("label", "rid").alias("label"))
    )
    member = full.select("own_id", "a", "b", "n").join(vertex, ["a", "b", "n"])
    if "doc_id" in rows.columns:  # labels are hashes of rows then: the component's id is its least doc_id
        names = member.groupBy("label").agg(F.min("own_id").alias("name"))
        member = member.join(names, "label").drop("label").withColumnRenamed("name", "label")
    every = member.select("own_id", "n", "label").unionByName(signed.filter("n = 0").select("own_id", "n", F.col("own_id").alias("label")))
    return every.select(
        F.col("own_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), F.col("own_id").eqNullSafe(F.col("label")).alias("kept")
    )


def _sketch(tokens: str):
    """The low byte of every token, as binary."""
    return F.unhex(F.array_join(F.transform(F.slice(tokens, 1, SKETCH), lambda t: F.lpad(F.hex(t.bitwiseAND(255)), 2, "0")), ""))


@register(
    "op7_near_dedup",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
          WHEN len(ws) = 1 THEN ws ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    e AS (SELECT u, v FROM p JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * i >= 80 * (a.n + b.n - i)),
    l AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.u, r.c FROM r JOIN l ON l.v = r.doc_id),
    m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
    SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, w.doc_id = c AS kept
    FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
)
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
