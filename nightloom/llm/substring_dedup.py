"""Repeated word sequences by recompression.

A text is a sequence of word names.  Each round first names maximal runs of one symbol, then splits the alphabet in two
halves by a bit of the symbol's name and names every pair (left-half symbol, right-half symbol); the sequence shrinks to
about three quarters.  Names are 64-bit functions of what they stand for: all tasks agree on them without a dictionary,
and equal substrings get equal symbols except near their ends.  How near is known exactly, because every symbol carries
the range of words that its existence depends on.  A window of ``span`` words is looked up by the highest symbol whose
range lies inside the window; symbols that occur twice reveal repeats, and the names of whole pieces or, where pieces
under one symbol differ, of whole windows verify them: two names modulo 2**61 - 1, over other word names and with other bases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as T
from ._repeats import anchor_batch, covered, repeated_pieces
from ._shared import keyed_rows
from .registry import register, table

ROUNDS = 7
RUN_ROUNDS = (0, 3)


class Level:
    """Symbols of one round: name, first and end word, first and end word they depend on, and whether a row starts."""

    def __init__(self, name, lo, hi, dlo, dhi, head):
        self.name, self.lo, self.hi, self.dlo, self.dhi, self.head = name, lo, hi, dlo, dhi, head

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """What the left neighbour depends on at its left, the right one at its right; beyond a row's edge: outside."""
        left = self.lo - 1
        left[1:] = np.where(self.head[1:], left[1:], self.dlo[:-1])
        right = self.hi + 1
        right[:-1] = np.where(self.head[1:], right[:-1], self.dhi[1:])
        return left, right

    def runs(self, seed: int) -> Level:
        """Maximal runs become one symbol.  That a run ends where it does depends on both neighbours."""
        same = np.zeros(len(self.name), bool)
        same[1:] = (self.name[1:] == self.name[:-1]) & ~self.head[1:]
        left, right = self.neighbours()
        first = np.flatnonzero(~same)
        last = np.append(first[1:], len(same)) - 1
        size = (last - first + 1).astype(np.uint64)
        name = self.name[first]
        name = np.where(size > 1, T.mix(name * np.uint64(0x9FB21C651E98DF25) + size + np.uint64(seed)), name)
        return Level(name, self.lo[first], self.hi[last], left[first], right[last], self.head[first])

    def pairs(self, seed: int) -> Level:
        """Left-half symbol and right-half symbol become one.  A symbol left alone depends on the one it did not join."""
        right_half = (T.mix(self.name + np.uint64(seed)) >> np.uint64(40)) & np.uint64(1) == 1
        joins = np.zeros(len(right_half), bool)
        joins[:-1] = ~right_half[:-1] & right_half[1:] & ~self.head[1:]
        tail = np.zeros(len(joins), bool)
        tail[1:] = joins[:-1]
        left, right = self.neighbours()
        at = np.flatnonzero(~tail)
        pair = joins[at]
        end = at + pair
        alone = ~pair
        name = np.where(pair, T.mix(self.name[at] * np.uint64(0xC2B2AE3D27D4EB4F) + self.name[end] + np.uint64(seed)), self.name[at])
        dlo = np.where(alone & right_half[at], left[at], self.dlo[at])
        dhi = np.where(alone & ~right_half[at], right[at], self.dhi[end])
        return Level(name, self.lo[at], self.hi[end], dlo, dhi, self.head[at])


def levels(names: np.ndarray, row_first: np.ndarray) -> list[Level]:
    at = np.arange(len(names), dtype=np.int64)
    head = np.zeros(len(names), bool)
    head[row_first[row_first < len(names)]] = True
    out = [Level(names, at, at + 1, at, at + 1, head)]
    for t in range(ROUNDS):
        x = out[-1]
        if t in RUN_ROUNDS:
            x = x.runs(101 * t + 7)
        out.append(x.pairs(211 * t + 13))
    return out


def window_anchors(names: np.ndarray, row_first: np.ndarray, row_end: np.ndarray, span: int):
    """For runs of consecutive windows with one anchor: row, first window, number of windows, anchor's word range."""
    row = np.repeat(np.arange(len(row_first)), np.maximum(row_end - row_first - span + 1, 0))
    if not len(row):
        return None
    count = np.maximum(row_end - row_first - span + 1, 0)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + row_first[row]
    lo, hi = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    left = np.arange(len(start))
    for level in reversed(levels(names, row_first)):
        s = start[left]
        at = np.minimum(np.searchsorted(level.dlo, s), len(level.dlo) - 1)
        good = (level.dlo[at] >= s) & (level.dhi[at] <= s + span)
        lo[left[good]], hi[left[good]] = level.dlo[at[good]], level.dhi[at[good]]
        left = left[~good]
        if not len(left):
            break
    new = np.ones(len(start), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(start)))
    return row[at], start[at], n, lo[at], hi[at]


def _anchors(batches: Iterator[pa.RecordBatch], names_only: bool, span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid = batch.column("rid").to_numpy()
        for lo, hi, data, offsets in T.slices(batch, "text"):
            starts, ends, rows = T.words(data, offsets)
            names = T.word_hashes(data, starts, ends)
            found = window_anchors(names, rows[:-1], rows[1:], span)
            if found is None:
                continue
            row, start, n, a, b = found
            key = T.Ranges(names, T.BASES[1]).range(a, b)
            piece = key if names_only else T.Ranges(T.word_hashes(data, starts, ends, 3), T.BASES[0]).range(start, start + n - 1 + span)
            yield anchor_batch(names_only, key, piece, rid[lo:hi][row], start - rows[row], n)


def _windows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """128-bit names of all windows of the representatives."""
    for batch in batches:
        for lo, hi, data, offsets in T.slices(batch, "text"):
            starts, ends, rows = T.words(data, offsets)
            one = T.Ranges(T.word_hashes(data, starts, ends, 1), T.BASES[1])
            two = T.Ranges(T.word_hashes(data, starts, ends, 2), T.BASES[0])
            reps = batch.column("reps").slice(lo, hi - lo)
            flat = reps.flatten()
            if not len(flat):
                continue
            row = np.repeat(np.arange(hi - lo), np.asarray(reps.value_lengths()))
            n = flat.field("n").to_numpy().astype(np.int64)
            at = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            s = (rows[row] + flat.field("start").to_numpy())[at] + off
            yield pa.RecordBatch.from_arrays(
                [T.longs(one.range(s, s + span)), T.longs(two.range(s, s + span)), pa.array(flat.field("key").to_numpy()[at]),
                 pa.array(flat.field("piece").to_numpy()[at]), pa.array(off.astype(np.int32))],
                ["a", "b", "key", "piece", "off"],
            )


def _resolve(reps: DataFrame, span: int) -> DataFrame:
    windows = reps.select("text", "reps").mapInArrow(partial(_windows, span=span), "a long, b long, key long, piece long, off int")
    twice = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("a", "b")
    return windows.join(twice, ["a", "b"], "left_semi").groupBy("key", "piece").agg(F.collect_list("off").alias("hits"))


def _removed(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        for text, pieces in zip(batch.column("text"), batch.column("pieces")):
            own = (text.as_py() or "").encode().split()
            gone = covered(len(own), pieces.as_py(), span)
            kept = b" ".join(compress(own, (~gone).tolist()) if gone.any() else own)
            out["n_words"].append(len(own))
            out["n_removed"].append(int(gone.sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode())
        yield pa.RecordBatch.from_arrays(
            [out["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept_text"], pa.string())],
            list(out),
        )


def substring_dedup(docs: DataFrame, span: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes each word that a window of ``span`` words covers whose sequence starts at a second place too.

    Words are runs of other bytes than space and 9 to 13; windows lie within one row and are judged on the input.
    Returns doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space), one row per input
    row.  Null and empty texts have no words; a text of fewer words than ``span`` is kept whole; overlapping repeats
    count, so a long run of one word goes; repeated rows are copies of each other and lose all their windows; rows may
    share a doc_id or have none; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows, own_id = keyed_rows(docs, doc_id, text)
    found = repeated_pieces(rows.select("rid", "text"), partial(_anchors, span=span), partial(_resolve, span=span))
    return rows.join(found, "rid", "left").select(own_id.alias("doc_id"), "text", "pieces").mapInArrow(
        partial(_removed, span=span), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )


@register("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
