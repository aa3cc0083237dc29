"""Prefix trie of conversations, measured by an Euler tour.

Every turn gets its place in its conversation by one sort over (conversation, turn), dealt by ranges, so that a
conversation of any length spreads over tasks; counts of the (conversation, partition) chunks say where each chunk begins.  Prefixes are named
by four running sums of 32-bit pieces of SHA-256(depth, turn): a set of (depth, turn) pairs is a sequence, sums spread over
chunks as counts do, and every node then checks that all its rows agree in their last turn and in their parent.

A node's children are neighbours in a sort by (parent, least member), so siblings are consecutive numbers.  Each node has
an enter and an exit arc; the arc after an enter arc enters the first child, or leaves a node without children, and the
arc after an exit arc enters the next sibling or leaves the parent.  The tour is ranked by contraction: in each round the
arcs whose hash is less than those of both neighbours, a third of all and no two of them adjacent, hand their weights to the arc
before them; the rounds' tables shrink geometrically, and putting arcs back in reverse order gives every arc the sum of
the weights from it to the end.  A subtree's leaves and savings are the difference between its enter and its exit arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import has_rows, stored
from .registry import register, table

#: Running sums restart after so many turns.
CHUNK = 4096
#: Conversation ids in one string on the way to a node's digest.
IDS = 4096
#: The contraction ends when the tour has so many arcs: those are walked in one task.
WALK = 4096
LAST_TURNS = 8  # a base gives at most this many turns
NAME = ("a", "b")


def _partition(gid: Column) -> Column:
    return F.shiftright(gid, 33).cast("int")


def _sorted_ids(df: DataFrame, *keys: str) -> DataFrame:
    """Adds gid: increasing in the order of keys over the whole table; keys may hold any skew if they differ by row."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("gid", F.monotonically_increasing_id())


def placed_turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(conv_id, gid, k1, k2, bytes) of every turn, and (conv_id, pid, start, before) of every chunk of the sort."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256).alias("key"),
        F.octet_length(text_).cast("long").alias("bytes"),
    ).filter("conv_id is not null")
    piece = lambda at: F.conv(F.substring("key", at, 15), 16, 10).cast("long")
    rows = rows.select("conv_id", "turn", piece(1).alias("k1"), piece(16).alias("k2"), "bytes").withColumn("row", F.monotonically_increasing_id())
    rows = stored(_sorted_ids(rows, "conv_id", "turn", "k1", "k2", "row").select("conv_id", "gid", "k1", "k2", "bytes"), "trie-turns")
    chunks = rows.groupBy("conv_id", _partition(F.col("gid")).alias("pid")).agg(F.min("gid").alias("start"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)  # at most a row for each partition
    return rows, chunks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def rebuilt_turns(rows: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, k1, k2, bytes, is_last) of the rebuilt conversations, and (conv_id, length)."""
    chunks = stored(chunks, "trie-chunks")
    lengths = chunks.groupBy("conv_id").agg(F.sum("n").alias("own"))
    base = (F.col("conv_id") - F.col("conv_id") % 5).alias("base")
    taken = F.when(F.col("conv_id") % 5 == 0, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("long")
    convs = lengths.select("conv_id", "own", base, taken.alias("h"))
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("theirs")), "base", "left")
    convs = convs.withColumn("given", F.least("h", F.coalesce("theirs", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "h", "given", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    # facts of a conversation go to its chunks first: a chunk is no larger than a partition, whatever the conversation
    near = chunks.select("conv_id", "pid", "start", "before").join(convs, "conv_id")
    place = (F.col("gid") - F.col("start") + F.col("before")).alias("place")
    turns = rows.withColumn("pid", _partition(F.col("gid"))).join(near, ["conv_id", "pid"])
    turns = stored(turns.select("conv_id", place, "k1", "k2", "bytes", "h", "given", "length"), "trie-placed")
    own = turns.filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("given") + 1).alias("depth"), "k1", "k2", "bytes", "length")
    heads = turns.filter((F.col("conv_id") % 5 == 0) & (F.col("place") < LAST_TURNS)).select(F.col("conv_id").alias("base"), "place", "k1", "k2", "bytes")
    takers = convs.filter("given > 0").select("conv_id", "base", "given", "length")
    lent = heads.join(takers, "base").filter("place < given").select("conv_id", (F.col("place") + 1).alias("depth"), "k1", "k2", "bytes", "length")
    every = own.unionByName(lent)
    return every.select("conv_id", "depth", "k1", "k2", "bytes", (F.col("depth") == F.col("length")).alias("is_last")), convs.select("conv_id", "length")


def named_prefixes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds the name (a, b) of the prefix that ends with each turn, and (pa, pb) of the one before it."""
    mark = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), F.col("k1").cast("string"), F.col("k2").cast("string")), 256)
    words = [F.conv(F.substring("mark", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"s{i}") for i in range(4)]
    rows = turns.withColumn("mark", mark).select("conv_id", "depth", "k1", "k2", "bytes", "is_last", F.floor((F.col("depth") - 1) / chunk).alias("chunk"), *words)
    rows = stored(rows, "trie-marks")
    sums = rows.groupBy("conv_id", "chunk").agg(*(F.sum(f"s{i}").alias(f"t{i}") for i in range(4)))
    # a conversation has a row here for each ``chunk`` turns, and most have none
    long = sums.filter("chunk > 0").select("conv_id").distinct()
    earlier = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = sums.join(long, "conv_id", "left_semi").select("conv_id", "chunk", *(F.sum(f"t{i}").over(earlier).alias(f"t{i}") for i in range(4))).filter("chunk > 0")
    inside = W.partitionBy("conv_id", "chunk").orderBy("depth")
    rows = rows.select("*", *(F.sum(f"s{i}").over(inside).alias(f"r{i}") for i in range(4)))
    rows = rows.join(before, ["conv_id", "chunk"], "left")
    full = [F.pmod(F.col(f"r{i}") + F.coalesce(f"t{i}", F.lit(0)), F.lit(1 << 32)) for i in range(4)]
    less = [F.pmod(full[i] - F.col(f"s{i}"), F.lit(1 << 32)) for i in range(4)]
    pair = lambda x, y: F.shiftleft(x - (1 << 31), 32).bitwiseOR(y)
    return rows.select(
        "conv_id", "depth", "k1", "k2", "bytes", "is_last", pair(full[0], full[1]).alias("a"), pair(full[2], full[3]).alias("b"),
        pair(less[0], less[1]).alias("pa"), pair(less[2], less[3]).alias("pb"),
    )


#: Name of the empty prefix: four sums of nothing.
ROOT = (-(1 << 63), -(1 << 63))


def trie_nodes(prefixes: DataFrame) -> DataFrame:
    """(a, b, depth, pa, pb, conv_id, n_convs, bytes) of every node but the root."""
    same = [F.min(c).alias(f"{c}_lo") for c in ("k1", "k2", "pa", "pb")] + [F.max(c).alias(f"{c}_hi") for c in ("k1", "k2", "pa", "pb")]
    nodes = stored(
        prefixes.groupBy("a", "b", "depth").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), *same),
        "trie-nodes",
    )
    apart = nodes.filter(" OR ".join(f"{c}_lo <> {c}_hi" for c in ("k1", "k2", "pa", "pb")))
    if has_rows(apart):
        raise ValueError("two different prefixes got the same 128-bit name")
    return nodes.select("a", "b", "depth", F.col("pa_lo").alias("pa"), F.col("pb_lo").alias("pb"), "conv_id", "n_convs", "bytes")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings, joined by commas; they come in order, and one is held at a time."""
    last, digest, out = None, None, []
    form = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        for a, b, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, b) != last:
                if last is not None:
                    out.append((*last, digest.hexdigest()))
                last, digest = (a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=form)
            out = []
    if last is not None:
        out.append((*last, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=form)


def end_digests(ends: DataFrame, ids: int = IDS) -> DataFrame:
    """(a, b, ends_sha256) from (a, b, conv_id).

    Strings of at most ``ids`` ids are joined in parallel.  SHA-256 itself reads them one after the other, so a node in
    which very many conversations end is one task's stream of those strings.
    """
    strings = ends.groupBy("a", "b", F.floor(F.col("conv_id") / ids).alias("at")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return strings.repartition("a", "b").sortWithinPartitions("a", "b", "at").select("a", "b", "ids").mapInArrow(_digests, "a long, b long, ends_sha256 string")


def numbered(nodes: DataFrame) -> DataFrame:
    """Adds idx 1, 2, ...: children of one parent are consecutive, by least member."""
    rows = stored(_sorted_ids(nodes, "pa", "pb", "conv_id"), "trie-sorted")
    sizes = rows.groupBy(_partition(F.col("gid")).alias("pid")).agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = sizes.select("pid", F.coalesce(F.sum("n").over(W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("gid").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("pid", _partition(F.col("gid"))).join(F.broadcast(before), "pid")
    return rows.withColumn("idx", place + F.col("before") + 1).drop("pid", "gid", "before")


def tour_nodes(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes with the root, each with its first and last child, its first and last sibling, its parent's idx and conv_id."""
    rows = numbered(nodes)
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = top.select(
        F.lit(ROOT[0]).alias("a"), F.lit(ROOT[1]).alias("b"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("idx"),
    )
    rows = stored(rows.select(*root.columns).unionByName(root), "trie-numbered")
    family = rows.filter("pa is not null").groupBy("pa", "pb").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("n_children"))
    rows = stored(rows.join(family.withColumnsRenamed({"pa": "a", "pb": "b"}), ["a", "b"], "left"), "trie-family")
    above = rows.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("idx").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("first").alias("eldest"), F.col("last").alias("youngest"))
    return stored(rows.join(above, ["pa", "pb"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie-tour")


def arcs(nodes: DataFrame) -> DataFrame:
    """The tour as a list: (arc, before, after, leaves, saved); 2 * idx enters a node and 2 * idx + 1 leaves it."""
    enter, leave = (lambda c: 2 * F.col(c)), (lambda c: 2 * F.col(c) + 1)
    inner = F.col("n_children") > 0
    nothing = F.lit(0).cast("long")
    going = F.struct(
        enter("idx").alias("arc"), F.when(F.col("idx") > F.col("eldest"), 2 * F.col("idx") - 1).otherwise(enter("up")).alias("before"),
        F.when(inner, enter("first")).otherwise(leave("idx")).alias("after"), F.when(inner, 0).otherwise(1).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    coming = F.struct(
        leave("idx").alias("arc"), F.when(inner, leave("last")).otherwise(enter("idx")).alias("before"),
        F.when(F.col("idx") < F.col("youngest"), 2 * F.col("idx") + 2).otherwise(leave("up")).alias("after"), nothing.alias("leaves"), nothing.alias("saved"),
    )
    return nodes.select(F.explode(F.array(going, coming)).alias("x")).select("x.*")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums from each arc to the end, for the last few arcs of a contraction."""
    rows = {}
    for batch in batches:
        for arc, before, after, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
            rows[arc] = (before, after, leaves, saved)
    at = next((arc for arc, (_, after, _, _) in rows.items() if after is None), None)
    out, leaves, saved = [], 0, 0
    while at is not None:
        leaves, saved = leaves + rows[at][2], saved + rows[at][3]
        out.append((at, leaves, saved))
        at = rows[at][0]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["arc", "leaves", "saved"])


def ranked(tour: DataFrame, walk: int = WALK) -> DataFrame:
    """(arc, leaves, saved): the weights summed from each arc to the end of its list."""
    columns = ["arc", "before", "after", "leaves", "saved"]
    tour = stored(tour.select(*columns), "trie-arcs")
    taken: list[DataFrame] = []
    while tour.count() > max(walk, 2):  # the two ends never go
        coin = lambda c, n=len(taken): F.xxhash64(F.col(c), F.lit(n))
        goes = F.col("before").isNotNull() & F.col("after").isNotNull() & (coin("arc") < coin("before")) & (coin("arc") < coin("after"))
        marked = tour.withColumn("goes", goes)
        out = marked.filter("goes").select(*columns)
        none = F.lit(None).cast("long")
        word = lambda arc, before, after, leaves, saved: F.struct(*(x.alias(c) for x, c in zip((arc, before, after, leaves, saved), columns)))
        own = F.array(word(*(F.col(c) for c in columns)))
        # an arc that goes tells the arc before it where to go on and what it weighed, and the one after it what comes before
        told = F.array(
            word(F.col("before"), none, F.col("after"), F.col("leaves"), F.col("saved")), word(F.col("after"), F.col("before"), none, none, none)
        )
        heard = marked.select(F.when(F.col("goes"), told).otherwise(own).alias("words"), "goes").select(F.explode("words").alias("x"), F.col("goes").alias("news"))
        newest = lambda c: F.max(F.struct(F.col(f"x.{c}").isNotNull(), "news", F.col(f"x.{c}")))[f"{c}"].alias(c)
        tour = stored(
            heard.groupBy(F.col("x.arc").alias("arc")).agg(newest("before"), newest("after"), F.sum("x.leaves").alias("leaves"), F.sum("x.saved").alias("saved")),
            "trie-arcs",
        )
        taken.append(out)
    sums = stored(tour.select(*columns).repartition(1).mapInArrow(_walked, "arc long, leaves long, saved long"), "trie-sums")
    for out in reversed(taken):
        follows = sums.select(F.col("arc").alias("after"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
        back = out.join(follows, "after").select("arc", (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved"))
        sums = stored(sums.unionByName(back), "trie-sums")
    return sums


def prefix_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", walk: int = WALK, chunk: int = CHUNK
) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Conversations are ordered by turn (null first; equal turns by a digest of role and text, so repeated rows are turns
    of their own); null roles and texts are empty; rows of a null conv_id take no part.  Every conversation c is rebuilt
    from the first crc32(c) % 9 turns of conversation c - c % 5 and its own turns after as many.  A conversation that ends
    up without turns is a member of the root only.  Texts of any length count with their UTF-8 bytes.  Other columns are
    ignored, whatever their names.  An empty table has no member, hence no node and no rows.
    """
    rows, chunks = placed_turns(conversations, conv_id, turn, role, text)
    turns, members = rebuilt_turns(rows, chunks)
    prefixes = stored(named_prefixes(turns, chunk), "trie-prefixes")
    ends = prefixes.filter("is_last").select("a", "b", "conv_id").unionByName(
        members.filter("length = 0").select(F.lit(ROOT[0]).alias("a"), F.lit(ROOT[1]).alias("b"), "conv_id")
    )
    nodes = tour_nodes(trie_nodes(prefixes), members)
    sums = ranked(arcs(nodes), walk)
    idx = F.shiftright("arc", 1).alias("idx")
    sign = F.when(F.col("arc") % 2 == 0, 1).otherwise(-1)  # what lies between entering and leaving a node
    under = sums.groupBy(idx).agg(F.sum(F.col("leaves") * sign).alias("n_leaves"), F.sum(F.col("saved") * sign).alias("saved_tokens"))
    done = nodes.join(under, "idx").join(end_digests(ends), ["a", "b"], "left")
    return done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


@register(
    "op13_prefix_trie",
    """
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    c AS MATERIALIZED (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS own,
        xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
            lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 9 AS h
        FROM t GROUP BY conv_id),
    r AS MATERIALIZED (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS seq FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
    p AS MATERIALIZED (SELECT conv_id, len(seq) AS length, d AS depth, seq[1:d] AS prefix, CASE WHEN d > 0 THEN strlen(seq[d].t) ELSE 0 END AS bytes
        FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM r)),
    n AS MATERIALIZED (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
        FROM p GROUP BY depth, prefix),
    m AS MATERIALIZED (SELECT p.conv_id AS member, n.depth, n.conv_id FROM p JOIN n ON p.depth = n.depth AND p.prefix = n.prefix),
    u AS MATERIALIZED (SELECT n.*, m.conv_id AS parent_conv_id FROM n LEFT JOIN m ON m.member = n.conv_id AND m.depth = n.depth - 1),
    k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
    s AS (SELECT m.conv_id, m.depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum(u.saved) AS saved_tokens
        FROM u LEFT JOIN k ON k.conv_id = u.conv_id AND k.depth = u.depth JOIN m ON m.member = u.conv_id AND m.depth <= u.depth GROUP BY m.conv_id, m.depth)
    SELECT u.conv_id, u.depth, u.parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, u.ends_sha256
    FROM u JOIN s ON s.conv_id = u.conv_id AND s.depth = u.depth LEFT JOIN k ON k.conv_id = u.conv_id AND k.depth = u.depth
    """,
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
