"""Benchmark decontamination by q-gram counts in diagonal bands and banded alignment.

Every item has a window at each of its places.  A window of m characters with at most e edits shares m - q + 1 - q e
q-grams with what it was copied to, all on diagonals within e of each other.  The q-grams that a text shares with an
item are therefore counted in overlapping bands of diagonals; bands below the bound cannot hold a copy, and in the
others a sliding count over the item's places leaves the windows that are aligned in the band.  Texts pass in one narrow
step, whole; the items are broadcast in blocks of a fixed size, so a larger benchmark means more passes and no larger
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as T
from .registry import register, table

Q, WINDOW, STRIDE, RATE = 8, 100, 1, 0.1
#: Width of a band of diagonals, and characters of items in one broadcast block.
BAND, BLOCK = 16, 8 << 20
BITS = 22
GAP = 0x110000


def normal(text: str | None) -> str:
    """Lower case, white space as single blanks."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(code: np.ndarray, q: int) -> np.ndarray:
    """Name of the q-gram at each place, by doubling: names of 1, 2, 4, ... characters are put together."""
    n = len(code) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, at = code.astype(np.uint64) + np.uint64(1), 1, 0
    out = np.zeros(n, np.uint64)
    weight = np.array([T.BASES[0]], np.uint64)
    while size <= q:
        if q & size:
            out = out * weight + power[at : at + n]
            at += size
        if 2 * size <= q:
            power = power[:-size] * weight + power[size:]
        weight = weight * weight
        size *= 2
    return T.mix(out)


@dataclass
class Window:
    item: int
    start: int
    code: np.ndarray
    edits: int


def shape(length: int, q: int, window: int, rate: float) -> tuple[int, int]:
    """Characters and edits of an item's windows; an item shorter than a window is one, with fewer edits if the bound
    would else be empty."""
    m = min(window, length)
    edits = int(rate * m)
    while edits and m - q + 1 - q * edits < 1:
        edits -= 1
    return m, edits


def cover(item: int, code: np.ndarray, q: int, window: int, stride: int, rate: float) -> list[Window]:
    """Windows of an item."""
    m, edits = shape(len(code), q, window, rate)
    starts = sorted({*range(0, len(code) - m + 1, stride), len(code) - m})
    return [Window(item, s, code[s : s + m], edits) for s in starts]


class Index:
    """q-grams of a block of items, sorted by name, and a bit table that most other q-grams fail."""

    def __init__(self, items: list[tuple[int, str]], q: int, window: int, stride: int, rate: float):
        self.q, self.stride = q, stride
        self.ids = [i for i, _ in items]
        texts = [codes(normal(t)) for _, t in items]
        self.code = np.concatenate([*texts, np.zeros(0, np.uint32)])
        self.length = np.array([len(c) for c in texts], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.short = [(k, normal(t)) for k, (_, t) in enumerate(items) if 0 < len(texts[k]) < q]
        shapes = [shape(len(c), q, window, rate) if len(c) >= q else (q, 0) for c in texts]
        self.size, self.edits = np.array(shapes, np.int64).reshape(-1, 2).T
        self.least = self.size - q + 1 - q * self.edits
        names = [grams(c, q) for c in texts]
        name = np.concatenate([*names, np.zeros(0, np.uint64)])
        order = np.argsort(name)
        self.name = name[order]
        self.item = np.repeat(np.arange(len(names)), [len(x) for x in names])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in names] + [np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[(self.name >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the text, item, place in the item of every shared q-gram."""
        name = grams(code, self.q)
        at = np.flatnonzero(self.bits[(name >> np.uint64(64 - BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.name, name[at], "left"), np.searchsorted(self.name, name[at], "right")
        n = hi - lo
        k = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.item[k], self.place[k]

    def starts(self, item: int, places: np.ndarray) -> np.ndarray:
        """Starts of the item's windows that hold enough of its sorted places: those from which the first and the last
        of as many successive places as are needed lie inside."""
        least, last = int(self.least[item]), int(self.length[item] - self.size[item])
        lo = np.maximum(places[least - 1 :] - (self.size[item] - self.q), 0)
        hi = np.minimum(places[: len(lo)], last)
        lo, hi = lo[lo <= hi], hi[lo <= hi]
        lo[1:] = np.maximum(lo[1:], hi[:-1] + 1)  # each start once
        n = np.maximum(hi - lo + 1, 0)
        start = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return start[(start % self.stride == 0) | (start == last)]

    def regions(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, start and band of the windows that share enough q-grams on the diagonals of a band; a diagonal counts in
        two bands where they overlap.

        A first count takes whole items; what it leaves is counted by window, each place of the window once.
        """
        none = np.zeros(0, np.int64)
        at, item, place = self.hits(code)
        if not len(at):
            return none, none, none
        shift = 1 << 36
        diagonal = at - place + shift
        band = diagonal // BAND
        twice = diagonal % BAND < self.edits[item]
        key = np.concatenate([item << 40 | band, item[twice] << 40 | (band[twice] - 1)])
        place = np.concatenate([place, place[twice]])
        kinds, group, count = np.unique(key, return_inverse=True, return_counts=True)
        enough = count >= self.least[kinds >> 40]
        left = enough[group]
        pairs = np.unique(group[left] << 32 | place[left])
        kept = np.flatnonzero(enough)
        ends = np.searchsorted(pairs, np.append(kept, len(kinds)) << 32)
        starts = [self.starts(int(kinds[k] >> 40), pairs[a:b] & 0xFFFFFFFF) for k, a, b in zip(kept, ends[:-1], ends[1:])]
        n = [len(x) for x in starts]
        kinds = np.repeat(kinds[kept], n)
        return kinds >> 40, np.concatenate([*starts, none]), (kinds & ((1 << 40) - 1)) - shift // BAND


def align(patterns: np.ndarray, texts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against any stretch of its text that begins on one of ``width`` diagonals, and the
    text place behind it.  Row i of a text's table holds the ends i .. i + width - 1, so diagonals are columns."""
    n, m = patterns.shape
    k = np.arange(width, dtype=np.int32)
    cost = np.zeros((n, width), np.int32)
    for i in range(m):
        replace = cost + (texts[:, i : i + width] != patterns[:, i : i + 1])
        drop = np.full_like(cost, m + 1)
        drop[:, :-1] = cost[:, 1:] + 1
        cost = np.minimum.accumulate(np.minimum(replace, drop) - k, axis=1) + k
    at = np.argmin(cost, axis=1)
    return cost[np.arange(n), at], at + m


def verify(index: Index, code: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(item, start, end, edits) of the index's regions in a text that hold their window within its edits."""
    items, starts, bands = index.regions(code)
    kinds = np.stack([index.size[items], index.edits[items]], axis=1)
    for m, edits in np.unique(kinds, axis=0).tolist():
        jobs = np.flatnonzero((kinds == (m, edits)).all(axis=1))
        width = BAND + 3 * edits + 1
        for lo in range(0, len(jobs), 512):
            part = jobs[lo : lo + 512]
            begin = bands[part] * BAND + starts[part] - edits
            place = begin[:, None] + np.arange(m + width)
            inside = (place >= 0) & (place < len(code))
            texts = np.where(inside, code[np.clip(place, 0, len(code) - 1)], np.uint32(GAP))
            cost, end = align(index.code[(index.first[items[part]] + starts[part])[:, None] + np.arange(m)], texts, width)
            for j in np.flatnonzero(cost <= edits):
                stop = int(begin[j] + end[j])
                yield int(items[part[j]]), max(stop - m, 0), stop, int(cost[j])


OUT = "doc_id long, item_id long, start long, end long, edits int, windows int"


def _best(found: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, int, int, int]]:
    """Per item: first start, last end, fewest edits of a window, number of different windows' matches."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for item, start, end, edits in sorted(set(found)):
        s, e, c, n = best.get(item, (start, end, edits, 0))
        best[item] = (min(s, start), max(e, end), min(c, edits), n + 1)
    return best


def leaks(index: Index, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, start, end, edits, windows) for a list of normalised texts.

    They are searched as one long text, with gaps between them that no alignment can afford to cross.
    """
    parts = [codes(t) for t in texts]
    gap = np.full(int(index.edits.max(initial=0)) + 1, GAP, np.uint32)
    code = np.concatenate([x for p in parts for x in (p, gap)])
    begin = np.concatenate([[0], np.cumsum([len(p) + len(gap) for p in parts])])
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for item, start, end, edits in verify(index, code):
        row = int(np.searchsorted(begin, end, "left")) - 1
        base = int(begin[row])
        found.setdefault(row, []).append((item, max(start - base, 0), min(end - base, len(parts[row])), edits))
    for item, text in index.short:
        for row, t in enumerate(texts):
            at = t.find(text)
            if at >= 0:
                found.setdefault(row, []).append((item, at, at + len(text), 0))
    for row in sorted(found):
        for item, (s, e, c, n) in _best(found[row]).items():
            yield row, item, s, e, c, n


def _leaks(batches: Iterator[pa.RecordBatch], items, q: int, window: int, stride: int, rate: float) -> Iterator[pa.RecordBatch]:
    index = Index(items.value, q, window, stride, rate)
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, _, _ in T.slices(batch, "text"):
            texts = [normal(t) for t in batch.column("text").slice(lo, hi - lo).to_pylist()]
            rows = list(leaks(index, texts))
            if rows:
                row, item, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(pa.array(row)), pa.array([index.ids[i] for i in item], pa.int64()),
                     pa.array(rest[0], pa.int64()), pa.array(rest[1], pa.int64()), pa.array(rest[2], pa.int32()), pa.array(rest[3], pa.int32())],
                    ["doc_id", "item_id", "start", "end", "edits", "windows"],
                )


def item_blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block`` characters, by hash; the number of blocks follows from the table's size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(size // block) + 1
    part = F.pmod(F.xxhash64("text"), F.lit(blocks))
    for k in range(blocks):
        yield [(r.item_id, r.text) for r in rows.filter(part == k).collect()]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, window: int = WINDOW, stride: int = STRIDE, rate: float = RATE,
    doc_id: str = "doc_id", text: str = "text", block: int = BLOCK,
) -> DataFrame:
    """doc_id, item_id, start, end, edits, windows: a row for each text and item of which it holds a window.

    Texts and items are compared in lower case with white space as single blanks, and start and end count characters of
    that form.  A window of ``window`` characters matches with up to ``rate`` edits; items shorter than that must match
    as a whole, those shorter than q exactly.  Null and empty texts and items match nothing; repeated rows are reported
    each; of ties the first place counts; a null id stays null; other columns are ignored, whatever their names; an empty
    table on either side gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    context = docs.sparkSession.sparkContext
    passes = [
        rows.mapInArrow(partial(_leaks, items=context.broadcast(items), q=q, window=window, stride=stride, rate=rate), OUT)
        for items in item_blocks(benchmark, block)
    ]
    return reduce(DataFrame.unionByName, passes)


def _clean(batches: Iterator[pa.RecordBatch], items, text: str) -> Iterator[pa.RecordBatch]:
    index = Index(items.value, Q, WINDOW, STRIDE, RATE)
    for batch in batches:
        for lo, hi, _, _ in T.slices(batch, text):
            part = batch.slice(lo, hi - lo)
            texts = [normal(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            bad = {row for row, *_ in leaks(index, texts)}
            yield part.filter(pa.array([i not in bad for i in range(len(texts))]))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs, with all their columns, in which no item's window is found; one narrow pass for each block."""
    for items in item_blocks(benchmark, block):
        docs = docs.mapInArrow(partial(_clean, items=docs.sparkSession.sparkContext.broadcast(items), text=text), docs.schema)
    return docs


@register("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
