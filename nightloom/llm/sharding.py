"""Sharding by fixed virtual slots.

A record's slot is a hash of its id and never changes.  A versioned map says which shard holds which slot: version 0
deals slots evenly, and each rebalancing is an edit of the last version that moves as few slots as the measured bytes
ask for.  The map and the sums per slot have as many rows as there are slots, a parameter, whatever the data; they are
all that passes the driver or is broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import has_files
from ._shared import scratch
from .registry import register, table

SLOTS = 4096


def even_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalance(held: list[int], size: list[int], shards: int) -> list[int]:
    """Edits a map until no shard can give a slot to the emptiest one and both gain.

    Overfull shards give away slots, largest fitting first, and each given slot goes to the emptiest shard; then single
    moves and swaps between the fullest and the emptiest shard shrink what is left.
    """
    shard = list(held)
    load = [0] * shards
    inside: list[list[int]] = [[] for _ in range(shards)]
    for s, h in enumerate(shard):
        load[h] += size[s]
        inside[h].append(s)
    mean = sum(load) / shards
    given = []
    for h in range(shards):
        for s in sorted(inside[h], key=lambda s: -size[s]):
            if size[s] and load[h] - size[s] >= mean:
                load[h] -= size[s]
                given.append(s)
    heap = [(b, h) for h, b in enumerate(load)]
    heapq.heapify(heap)
    for s in sorted(given, key=lambda s: (-size[s], s)):
        b, h = heapq.heappop(heap)
        shard[s] = h
        heapq.heappush(heap, (b + size[s], h))
    load = [0] * shards
    for s, h in enumerate(shard):
        load[h] += size[s]
    for _ in range(4 * shards):
        full, low = max(range(shards), key=lambda h: (load[h], -h)), min(range(shards), key=lambda h: (load[h], h))
        gap = load[full] - load[low]
        ours = sorted((size[s], s) for s, h in enumerate(shard) if h == full and size[s])
        theirs = [(0, -1), *sorted((size[s], s) for s, h in enumerate(shard) if h == low)]
        best, at = None, 0
        for a, s in ours:  # the best swap moves half the gap; both lists are sorted, so one sweep finds it
            while at + 1 < len(theirs) and abs(gap - 2 * (a - theirs[at + 1][0])) <= abs(gap - 2 * (a - theirs[at][0])):
                at += 1
            left = abs(gap - 2 * (a - theirs[at][0]))
            if left < gap and (best is None or left < best[0]):
                best = (left, s, theirs[at][1], a - theirs[at][0])
        if best is None:
            break
        _, s, back, moved = best
        shard[s] = low
        if back >= 0:
            shard[back] = full
        load[full] -= moved
        load[low] += moved
    return shard


def grow(held: list[int], size: list[int], shards: int) -> list[int]:
    """One more shard: it takes slots from the fullest shards until it has its share; nothing else moves."""
    shard, new = list(held), shards
    load = [0] * (shards + 1)
    for s, h in enumerate(shard):
        load[h] += size[s]
    share = sum(load) / (shards + 1)
    for s in sorted(range(len(shard)), key=lambda s: (-size[s], s)):
        if load[shard[s]] - size[s] >= share * 0.999 and load[new] + size[s] <= share:
            load[shard[s]] -= size[s]
            load[new] += size[s]
            shard[s] = new
    return shard


def write_map(spark: SparkSession, folder: str, version: int, shard: list[int], base: list[int]) -> None:
    """A version is a folder of its own: readers of older ones are not disturbed."""
    values = [F.split(F.lit(",".join(map(str, x))), ",")[F.col("vslot").cast("int")].cast("long") for x in (shard, base)]
    (
        spark.range(0, len(shard), 1, 1).withColumnRenamed("id", "vslot")
        .select(F.col("vslot").cast("int").alias("vslot"), values[0].cast("int").alias("shard"), values[1].alias("base"))
        .write.mode("errorifexists").parquet(f"{folder}/version={version}")
    )


def last_map(spark: SparkSession, folder: str) -> tuple[list[int] | None, int]:
    """Shard of each slot in the newest version, and its number; (None, -1) for a folder without one."""
    if not has_files(spark, folder):
        return None, -1
    stored = spark.read.parquet(folder).select("version", "vslot", "shard")
    newest = stored.agg(F.max("version")).first()[0]
    return [r.shard for r in stored.filter(F.col("version") == newest).orderBy("vslot").collect()], newest  # as many rows as slots


def sized_rows(docs: DataFrame, slots: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_sizes(rows: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; at most ``slots`` rows reach the driver."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c")).collect():
        size[r.vslot], count[r.vslot] = r.b, r.c
    return size, count


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS, map_folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot for each input row, under the law ``bytes``.

    slot numbers the rows of a shard from 0 without gaps; vslot is the virtual slot.  The map is kept in ``map_folder``:
    a new folder gets version=0 (even) and version=1 (edited by bytes); a later call edits the last version n, by bytes or,
    for more shards, by letting the new ones take slots, and writes n+1; no version is ever overwritten.  Fewer shards than the
    last version has, or another number of slots, are an error.  A null text has 0 bytes, a null id a slot of its own; equal
    ids share a slot; ties in id are numbered by checksum and size; other columns are ignored, whatever their names; an
    empty table gives no rows.  One text larger than a shard's share makes its shard larger by that much, no more.
    """
    spark = docs.sparkSession
    folder = map_folder or scratch(spark, "shard-map")
    rows = sized_rows(docs, slots, doc_id, text)
    size, count = slot_sizes(rows, slots)

    def bases(shard: list[int]) -> list[int]:
        at, out = [0] * shards, []
        for s, h in enumerate(shard):
            out.append(at[h])
            at[h] += count[s]
        return out

    held, version = last_map(spark, folder)
    if held is None:
        held, version = even_map(slots, shards), 0
        write_map(spark, folder, 0, held, bases(held))
    had = max(held) + 1
    if len(held) != slots or had > shards:
        raise ValueError(f"the stored map has {had} shards and {len(held)} slots")
    edited = held if had < shards else rebalance(held, size, shards)
    for more in range(had, shards):
        edited = grow(edited, size, more)
    write_map(spark, folder, version + 1, edited, bases(edited))
    latest = spark.read.parquet(f"{folder}/version={version + 1}")
    inside = W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(inside) - 1)
        .join(F.broadcast(latest), "vslot")  # as many rows as slots
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "vslot",
        )
    )


@register("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 24)
