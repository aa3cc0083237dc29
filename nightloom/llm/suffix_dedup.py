"""Repeated byte strings by induced sorting of shard suffix arrays.

Suffixes that can share ``span`` bytes must meet in one shard: a window's anchor (its least 100-byte gram by a hash)
names the shard, see ``_repeats``.  Where one anchor has several different pieces, the pieces form shards whose suffix
arrays are built by induced sorting: suffixes are classified as smaller or larger than their right neighbour, the
leftmost-smaller substrings are sorted by one induction, their names recursively (by doubling), and a second induction
orders all suffixes; both inductions move through the buckets in whole waves, so NumPy does the linear work.  Common
prefixes are taken in text order (permuted), directly where they are irreducible and as the previous value minus one
elsewhere.  An anchor with more pieces than a shard holds is cut into several shards; what is left single there is
matched across shards by 128-bit names, one row for each different window and shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _words as T
from ._repeats import anchor_batch, covered, repeated_pieces
from ._shared import keyed_rows
from .registry import register, table

GRAM = 100
#: Different pieces of one anchor in one shard, and bytes of pieces whose arrays are built at once.
SHARD_PIECES = 4096
SHARD_BYTES = 1 << 20


def least_grams(data: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the slice: place and name of its least gram, the leftmost of equals."""
    grams = len(data) - gram + 1
    at = np.arange(grams)
    value = T.Rolling(T.table_of(3)[data], T.BASES[0]).range(at, at + gram)
    bits = max(1, int(grams).bit_length())
    place = np.uint64((1 << bits) - 1)
    low = (value & ~place) | np.arange(grams, dtype=np.uint64)
    wide, size = span - gram + 1, 1
    while 2 * size <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < wide:
        low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    at = (low & place).astype(np.int64)
    return at, value


def _anchors(batches: Iterator[pa.RecordBatch], names_only: bool, span: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid = batch.column("rid").to_numpy()
        for lo, hi, data, offsets in T.slices(batch, "text"):
            count = np.maximum(np.diff(offsets) - span + 1, 0)
            if not count.any():
                continue
            at, value = least_grams(data, span, gram)
            row = np.repeat(np.arange(hi - lo), count)
            start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + offsets[row]
            place = at[start]
            new = np.ones(len(start), bool)
            new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(start)))
            row, start, place = row[first], start[first], place[first]
            key = value[place]
            piece = key if names_only else T.Ranges(data, T.BASES[1]).range(start, start + n - 1 + span)
            yield anchor_batch(names_only, key, piece, rid[lo:hi][row], start - offsets[row], n)


def _place(sa, chars, at, ptr, step):
    """Appends suffixes to their buckets in the given order: upward from ptr (step 1) or downward (step -1)."""
    order = np.argsort(chars, kind="stable")
    grouped = chars[order]
    new = np.ones(len(grouped), bool)
    new[1:] = grouped[1:] != grouped[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(grouped)))
    rank = np.arange(len(grouped)) - np.repeat(first, size)
    sa[ptr[grouped] + step * rank] = at[order]
    ptr[grouped[first]] += step * size


def induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Suffix order from the order of the leftmost-smaller suffixes ``lms``; edges: first place of each bucket."""
    n = len(text)
    sa = np.full(n, -1, np.int64)
    tails = edges[1:] - 1
    lms_char = text[lms]
    by_char = np.argsort(lms_char, kind="stable")
    lms = lms[by_char]
    bounds = np.searchsorted(lms_char[by_char], np.arange(len(edges)))
    used = np.flatnonzero(edges[1:] > edges[:-1])
    ptr = edges[:-1].copy()
    for c in used:  # larger suffixes, left to right
        done = edges[c]
        while True:
            wave = sa[done : ptr[c]]
            if not len(wave):
                break
            done = ptr[c]
            at = wave - 1
            at = at[at >= 0]
            at = at[~smaller[at]]
            if len(at):
                _place(sa, text[at], at, ptr, 1)
        at = lms[bounds[c] : bounds[c + 1]] - 1
        at = at[at >= 0]
        if len(at):
            _place(sa, text[at], at, ptr, 1)
    ptr = tails.copy()
    sa[0], ptr[0] = n - 1, -1  # nothing follows the last suffix, so nothing would induce it
    heads = edges[:-1]
    larger_end = heads + np.bincount(text[~smaller], minlength=len(heads))
    for c in used[::-1]:  # smaller suffixes, right to left
        done = tails[c]
        while True:
            wave = sa[ptr[c] + 1 : done + 1][::-1]
            if not len(wave):
                break
            done = ptr[c]
            at = wave - 1
            at = at[at >= 0]
            at = at[smaller[at]]
            if len(at):
                _place(sa, text[at], at, ptr, -1)
        at = sa[heads[c] : larger_end[c]][::-1] - 1
        at = at[at >= 0]
        at = at[smaller[at]]
        if len(at):
            _place(sa, text[at], at, ptr, -1)
    return sa


def order_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of names: names of pairs, of fours, ... until all differ."""
    rank, step = names, 1
    while True:
        order = np.argsort(rank, kind="stable")
        if rank.max() + 1 == len(rank):
            return order
        second = np.zeros(len(rank), np.int64)
        second[:-step] = rank[step:] + 1
        pair = rank * (len(rank) + 2) + second
        order = np.argsort(pair, kind="stable")
        new = np.ones(len(pair), np.int64)
        new[1:] = pair[order][1:] != pair[order][:-1]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new) - 1
        step *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers; the last one must be a single 0, smaller than all others."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    text = text.astype(np.int64)
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.zeros(n, bool)
    rises[change] = text[change] < text[change + 1]
    nearest = np.searchsorted(change, np.arange(n - 1))
    smaller = np.ones(n, bool)
    smaller[:-1] = rises[change[nearest]]
    is_lms = np.zeros(n, bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    edges = np.concatenate([[0], np.cumsum(np.bincount(text))])
    sa = induce(text, smaller, lms, edges)
    if len(lms) > 1:
        sorted_lms = sa[is_lms[sa]]
        end = np.append(lms[1:], n - 1) + 1  # a leftmost-smaller substring reaches up to the next one's first symbol
        content = T.Rolling(T.mix((2 * text + smaller + 1).astype(np.uint64)), T.BASES[0])
        name_of = np.zeros(n, np.uint64)
        name_of[lms] = content.range(lms, np.minimum(end, n))
        by = name_of[sorted_lms]
        new = np.ones(len(by), np.int64)
        new[1:] = by[1:] != by[:-1]
        rank = np.zeros(n, np.int64)
        rank[sorted_lms] = np.cumsum(new) - 1
        sa = induce(text, smaller, lms[order_names(rank[lms])], edges)
    return sa


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in suffix order, in text order.

    A value is irreducible where the two suffixes have different symbols before them; only those are compared directly,
    all others are the previous value minus one.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.arange(n)
    direct = np.ones(n, bool)
    direct[1:] = (before[1:] <= 0) | (text[:-1] != text[np.maximum(before[1:], 1) - 1])
    length = np.zeros(n, np.int64)
    look = at[direct & (before >= 0)]
    other, done = before[look], 0
    while len(look):  # the single last symbol ends every comparison
        same = text[look + done] == text[other + done]
        look, other, done = look[same], other[same], done + 1
        length[look] = done
    last = np.maximum.accumulate(np.where(direct, at, 0))
    return np.maximum(length[last] - (at - last), 0)


def shard_repeats(pieces: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all pieces of a shard: piece, offset, class (equal windows share one) and class size."""
    size = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    text = np.zeros(int(size.sum()) + len(pieces) + 1, np.int64)
    for b, p in zip(begin, pieces):
        text[b : b + len(p)] = p
        text[b : b + len(p)] += 2
        text[b + len(p)] = 1
    sa = suffix_array(text)
    prefix = permuted_prefixes(text, sa)
    n = size - span + 1
    piece = np.repeat(np.arange(len(pieces)), n)
    off = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    window = np.zeros(len(text), bool)
    window[begin[piece] + off] = True
    order = sa[window[sa]]
    kind = np.zeros(len(text), np.int64)
    kind[order] = np.cumsum(prefix[order] < span)
    own = kind[begin[piece] + off]
    return piece, off, own, np.bincount(own, minlength=1)[own]


HIT = "key long, piece long, hits array<int>, a long, b long"


def _emit(rows: list, span: int) -> pa.RecordBatch:
    """A row for each piece with repeats; of shards cut from a large anchor also one for each class, with its name."""
    pieces = [np.frombuffer(r[2], np.uint8) for r in rows]
    piece, off, own, size = shard_repeats(pieces, span)
    key, code, cut = (np.array([r[i] for r in rows]) for i in (0, 1, 3))
    found = size > 1
    with_hits, per_piece = np.unique(piece[found], return_counts=True)
    lead = np.zeros(len(own), bool)
    lead[np.unique(own, return_index=True)[1]] = True
    lead &= cut[piece]
    data = np.concatenate(pieces)
    begin = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
    s = begin[piece[lead]] + off[lead]
    names = [np.zeros(0, np.int64)] * 2
    if len(s):
        names = [T.Ranges(data, T.BASES[k]).range(s, s + span).view(np.int64) for k in (0, 1)]
    ends = np.concatenate([[0], np.cumsum(np.concatenate([per_piece, np.ones(len(s), np.int64)]))]).astype(np.int32)
    hits = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([off[found], off[lead]]).astype(np.int32)))
    at = np.concatenate([with_hits, piece[lead]])
    a, b = (pa.array(np.concatenate([np.zeros(len(with_hits), np.int64), x]), mask=np.arange(len(at)) < len(with_hits)) for x in names)
    return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(code[at]), hits, a, b], ["key", "piece", "hits", "a", "b"])


def _shards(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, part): whole shards are gathered up to SHARD_BYTES, so memory is bounded by one shard."""
    rows: list = []
    held, last = 0, None
    for batch in batches:
        for key, piece, part, cut, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (key, part) != last and held >= SHARD_BYTES:
                yield _emit(rows, span)
                rows, held = [], 0
            last = (key, part)
            rows.append((key, piece, data, cut))
            held += len(data)
    if rows:
        yield _emit(rows, span)


def _cut_pieces(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for text, reps in zip(batch.column("text").to_pylist(), batch.column("reps").to_pylist()):
            data = (text or "").encode()
            out += [(r["key"], r["piece"], data[r["start"] : r["start"] + r["n"] - 1 + span]) for r in reps]
            if len(out) > 20_000:
                yield _piece_batch(out)
                out = []
        if out:
            yield _piece_batch(out)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    key, piece, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(piece, pa.int64()), pa.array(data, pa.binary())], ["key", "piece", "data"])


def _resolve(reps: DataFrame, span: int) -> DataFrame:
    flat = reps.select(F.explode("reps").alias("r")).select("r.key", "r.piece")
    many = flat.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > SHARD_PIECES)
    pieces = reps.select("text", "reps").mapInArrow(partial(_cut_pieces, span=span), "key long, piece long, data binary")
    parts = F.coalesce(F.ceil(F.col("m") / (SHARD_PIECES // 2)), F.lit(1))
    dealt = (
        pieces.join(many, "key", "left")
        .select("key", "piece", F.pmod(F.col("piece"), parts).cast("int").alias("part"), F.col("m").isNotNull().alias("cut"), "data")
        .repartition("key", "part").sortWithinPartitions("key", "part")
    )
    rows = dealt.mapInArrow(partial(_shards, span=span), HIT)
    # one pass over the shards: pieces' own hits stand alone, a class meets its equals of other shards by its name
    meet = W.partitionBy(F.coalesce("a", "key"), F.coalesce("b", "piece"))
    counted = rows.withColumn("shards", F.count("a").over(meet)).filter("a is null or shards > 1")
    return counted.groupBy("key", "piece").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))


def _removed(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept_bytes": []}
        for text, pieces in zip(batch.column("text"), batch.column("pieces")):
            own = (text.as_py() or "").encode()
            gone = covered(len(own), pieces.as_py(), span)
            kept = np.frombuffer(own, np.uint8)[~gone].tobytes() if gone.any() else own
            out["n_bytes"].append(len(own))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(own) else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_bytes"].append(kept)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([out["doc_id"], *(pa.array(v, k) for v, k in zip(list(out.values())[1:], kinds))], list(out))


def suffix_dedup(docs: DataFrame, span: int = 200, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes each byte that a string of ``span`` bytes covers which starts at a second place too.

    Texts are UTF-8 bytes; matches lie within one row and are judged on the input.  Returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256 and kept_bytes (what is left; removal may cut a character), one row per
    input row.  Null and empty texts have no bytes; texts shorter than ``span`` are kept whole; overlapping repeats
    count; repeated rows are copies of each other; rows may share a doc_id or have none; other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    if not 1 <= gram <= span:
        raise ValueError("gram must be between 1 and span")
    rows, own_id = keyed_rows(docs, doc_id, text)
    found = repeated_pieces(rows.select("rid", "text"), partial(_anchors, span=span, gram=gram), partial(_resolve, span=span))
    return rows.join(found, "rid", "left").select(own_id.alias("doc_id"), "text", "pieces").mapInArrow(
        partial(_removed, span=span), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"
    )


@register("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
