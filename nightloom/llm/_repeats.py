"""Frame shared by the two searches for long repeats.

Both look for windows of a fixed span (words or bytes) that start at two places or more.  Each window picks one anchor
inside itself by a rule that sees nothing but the window's content, so equal windows pick equal anchors:

1. An anchor is named by its content.  Only a name that occurs twice can belong to a repeated window; names are counted
   with map-side combine, so a passage that a third of all rows share costs one row per task.
2. Consecutive windows with one anchor form a piece.  Pieces with equal names and equal content are copies: all their
   windows are repeats, and one representative stands for them from here on.
3. Where one name has several different pieces, the method at hand (symbol names, or sorted suffixes) finds which
   windows of the representatives repeat.
4. Spans go back to the rows by key; a row's own spans are the only list that is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored

ANCHOR = "key long, piece long, rid long, start int, n int"


def anchor_batch(names_only: bool, key, piece, rid, start, n) -> pa.RecordBatch:
    if names_only:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(rid), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
        ["key", "piece", "rid", "start", "n"],
    )


def repeated_pieces(
    docs: DataFrame, anchors: Callable[..., Iterator[pa.RecordBatch]], resolve: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """docs (rid, text) -> rid, pieces: array of (start, n, hits); hits null: all n windows repeat, else those offsets.

    ``anchors(batches, names_only)`` yields the anchors of each row; ``resolve`` takes representatives (rid, text,
    reps: array of (key, piece, start, n)) and returns key, piece, hits for those with repeats.
    """
    names = docs.mapInArrow(partial(anchors, names_only=True), "key long")
    # written first: a join of two plain shuffles lets Spark split the rows of a hot name
    shared = stored(names.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"), "shared-anchors")
    rows = docs.mapInArrow(partial(anchors, names_only=False), ANCHOR)
    found = stored(rows.join(shared, "key", "left_semi"), "found-anchors")
    # written as well: the last join then has plain shuffles on both sides, and the rows of a hot piece can be split
    pieces = stored(
        found.groupBy("key", "piece").agg(
            F.count(F.lit(1)).alias("m"), F.first("rid").alias("rid"), F.first("start").alias("start"), F.first("n").alias("n")
        ),
        "pieces",
    )
    mixed = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("p")).filter("p > 1").select("key")
    reps = (
        pieces.join(mixed, "key", "left_semi")
        .groupBy("rid").agg(F.collect_list(F.struct("key", "piece", "start", "n")).alias("reps"))
    )
    hits = resolve(docs.join(reps, "rid"))
    copies = pieces.filter("m > 1").select("key", "piece", F.lit(None).cast("array<int>").alias("hits"))
    single = hits.join(pieces.filter("m > 1").select("key", "piece"), ["key", "piece"], "left_anti")
    marks = found.join(copies.unionByName(single), ["key", "piece"])
    return marks.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "hits")).alias("pieces"))


def covered(size: int, pieces: list | None, span: int) -> np.ndarray:
    """True at each unit of a row that a repeated window covers."""
    if not pieces:
        return np.zeros(size, bool)
    edge = np.zeros(size + 1, np.int32)
    for p in pieces:
        if p["hits"] is None:
            edge[p["start"]] += 1
            edge[p["start"] + p["n"] - 1 + span] -= 1
        else:
            for h in p["hits"]:
                edge[p["start"] + h] += 1
                edge[p["start"] + h + span] -= 1
    return np.cumsum(edge[:-1]) > 0
