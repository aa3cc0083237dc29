"""Texts of an Arrow batch as NumPy arrays: bytes, words, rolling hashes.

All hashes are functions of the content alone, so every task gives equal strings equal names.  Words are named by a chain
of scrambled 8-byte lanes, long words by BLAKE2; ranges of a sequence by polynomials modulo the prime 2**61 - 1.  Neither
has the collisions of polynomials modulo 2**64, which serve only where a name is no more than a first key.  Texts are
handled in slices of about a megabyte, whatever the batch, so that temporaries stay small; one longer text is a slice of
its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Word separators: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer words are named by BLAKE2.
LONG_WORD = 256
#: What of a word's 8-byte lane counts, by the bytes that are left.
LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
PRIME = np.uint64((1 << 61) - 1)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_power_cache: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Invertible scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def table_of(seed: int) -> np.ndarray:
    """256 scrambled values, one for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 0x632BE59BD9B4E019))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; doubled, kept and reused."""
    have = _power_cache.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(1, np.uint64)
        while len(have) < size:
            step = np.uint64(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        if size <= 4 * SLICE:
            _power_cache[base] = have
    return have[:n]


class Rolling:
    """Hash of any range of a sequence of 64-bit values in constant time, by prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n + 1)

    def range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in the bytes) for runs of rows of about ``most`` bytes."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (one more entry than rows)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] |= inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    last[ends_at] |= inside[ends_at]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit names of byte ranges."""
    size = ends - starts
    name = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    bytes_ = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", bytes_.data, strides=(1,))
    left = np.flatnonzero(size <= LONG_WORD)
    at = starts[left]
    while len(left):
        rest = ends[left] - at
        name[left] = mix(mix(name[left]) * np.uint64(0xD6E8FEB86659FD93) ^ (lanes[at] & LANE[np.minimum(rest, 8)]))
        more = rest > 8
        left, at = left[more], at[more] + 8
    for i in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=str(seed).encode()).digest()
        name[i] = np.frombuffer(digest, np.uint64)[0]
    return name


def sequences(names: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit names of short runs of names: run i has the ``size[i]`` names from ``first[i]`` on."""
    name = mix(size.astype(np.uint64) + np.uint64(0x8CB92BA72F3D8DD7))
    for k in range(int(size.max(initial=0))):
        has = size > k
        if has.all():
            name = mix(name * np.uint64(0xD6E8FEB86659FD93) ^ names[first + k])
        else:
            name[has] = mix(name[has] * np.uint64(0xD6E8FEB86659FD93) ^ names[first[has] + k])
    return name


def _fold(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME, for values below 2**63."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo PRIME."""
    x0, x1, y0, y1 = x & _LOW31, x >> np.uint64(31), y & _LOW31, y >> np.uint64(31)
    middle, low = x0 * y1 + x1 * y0, x0 * y0
    return _fold((x1 * y1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + (low & PRIME) + (low >> np.uint64(61)))


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME; doubled, kept and reused."""
    have = _power_cache.get(-base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, times(have, np.uint64(pow(base, len(have), int(PRIME))))])
        if size <= 4 * SLICE:
            _power_cache[-base] = have
    return have[:n]


class Ranges:
    """Names below 2**61 of the ranges of a sequence of 64-bit values or of bytes, by prefix sums modulo a prime."""

    def __init__(self, values: np.ndarray, base: int):
        n, self.base = len(values), base % int(PRIME)
        weight = prime_powers(self.base, n)
        if values.dtype == np.uint8 and n <= 1 << 24:  # products of bytes with half a power add up without overflow
            terms = (values * (weight & _LOW31), values * (weight >> np.uint64(31)))
        else:
            full = times(values.astype(np.uint64) if values.dtype == np.uint8 else _fold(mix(values) >> np.uint64(1)), weight)
            terms = (full & _LOW31, full >> np.uint64(31))
        self.halves = [np.zeros(n + 1, np.uint64) for _ in terms]
        for half, term in zip(self.halves, terms):
            np.cumsum(term, out=half[1:])

    def range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = (_fold(half[end] - half[start]) for half in self.halves)
        inner = _fold(times(high, np.uint64(1 << 31)) + low)
        back = prime_powers(pow(self.base, -1, int(PRIME)), len(self.halves[0]))
        return _fold(times(inner, back[start]) + _fold(mix((end - start).astype(np.uint64)) >> np.uint64(1)))


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
