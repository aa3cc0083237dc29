"""Vectors of an Arrow batch as matrices, and exact integer products of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Whole numbers below this are exact in a double, and so are sums of products that stay below it.
EXACT = float(1 << 53)


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; shorter rows are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(column.offsets)
    flat = np.asarray(column.values).astype(np.float64)
    sizes = np.diff(ends)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = flat[ends[0] : ends[-1]]
    return out


def padded(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact, as longs.

    Partial sums are at most the product of the two lengths.  Up to 2**53 doubles hold them; beyond, longs do; a product
    that may not fit a long is an error.
    """
    most = float(np.abs(a).sum(1).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most >= 2.0**63:
        raise ValueError("inner products of these vectors exceed a long")
    return a.astype(np.int64) @ b.astype(np.int64).T


def whole(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for every component, as doubles."""
    return np.floor(rows * scale)


def longs(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column of longs."""
    flat = pa.array(rows.astype(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)


def doubles(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows, np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)
