"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are computed over whole texts in one narrow pass.  Each task sums what it sees of the labelled rows
(count, sums, products by class), Spark adds the sums up, and the driver turns them, some hundred numbers, into class
means, shrunken covariances and their Cholesky factors.  A score is the logistic of the difference of the two log
densities, from Mahalanobis distances by the cached factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as T
from ._shared import cut
from .registry import register, table

THRESHOLD = 0.3
#: Share of the pooled covariance in each class's, and of a sphere of the same trace in the result.
POOLED, SPHERE = 0.2, 0.05

_KINDS = np.full(256, 0, np.uint8)  # 0: other, lower-case letters and continuation bytes
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"#$%&*@^~_=+<>{}[]\\/", b"!?", b"|", b"\n", b" \t\r\x0b\x0c", bytes(range(0xC0, 0x100))), 1):
    _KINDS[list(_chars)] = _i
KINDS = 10
FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "point", "symbol", "shout", "bar", "line", "wide", "word_mean", "word_spread",
    "distinct_words", "same_as_last", "top_word", "distinct_lines",
)


def _per_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of values over each row's range; empty ranges give 0."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[rows[1:]] - sums[rows[:-1]]


def _distinct(row: np.ndarray, name: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different names in each row, and how often its commonest one occurs."""
    order = np.lexsort((name, row))
    row, name = row[order], name[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row[first], count)
    return np.bincount(row[first], minlength=n), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x features; an empty text has all zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row_of = np.repeat(np.arange(n), size)
    kinds = np.bincount(row_of * KINDS + _KINDS[data], minlength=n * KINDS).reshape(n, KINDS)
    starts, ends, rows = T.words(data, offsets)
    n_words = np.diff(rows)
    length = (ends - starts).astype(float)
    names = T.word_hashes(data, starts, ends)
    word_row = np.repeat(np.arange(n), n_words)
    distinct, most = _distinct(word_row, names, n)
    same = np.zeros(len(names), np.int64)
    same[1:] = (names[1:] == names[:-1]) & (word_row[1:] == word_row[:-1])
    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(offsets[:-1][size > 0], breaks + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_row = row_of[line_starts] if len(line_starts) else line_starts
    line_ends = np.append(line_starts[1:], len(data))
    line_names = T.Rolling(T.table_of(4)[data], T.BASES[1]).range(line_starts, line_ends)
    lines = np.bincount(line_row, minlength=n)
    different, _ = _distinct(line_row, line_names, n)
    w, b, at_least = np.maximum(n_words, 1), np.maximum(size, 1), np.maximum(lines, 1)
    mean = _per_row(length, rows) / w
    spread = np.sqrt(np.maximum(_per_row(length * length, rows) / w - mean * mean, 0))
    shares = [np.sqrt(kinds[:, k] / b) for k in (1, 2, 3, 4, 5, 6, 7, 9)]
    return np.column_stack(
        [np.log1p(size), np.log1p(n_words), *shares, np.log1p(mean), np.log1p(spread), distinct / w, np.sqrt(_per_row(same, rows) / w),
         np.sqrt(most / w), different / at_least]
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in T.slices(batch, "text"):
            x = statistics(data, offsets)
            arrays = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), arrays], ["doc_id", "x"])


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, x: the statistics of each row's whole text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_features, "doc_id long, x array<double>")


@dataclass
class Model:
    """Per class: log prior minus half the log determinant, mean, and inverse Cholesky factor; or a constant score."""

    shift: np.ndarray
    scale: np.ndarray
    offset: list[float]
    mean: list[np.ndarray]
    factor: list[np.ndarray]
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.shift) / self.scale
        log = []
        for c in (0, 1):
            u = (z - self.mean[c]) @ self.factor[c].T
            log.append(self.offset[c] - 0.5 * np.einsum("ij,ij->i", u, u))
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = len(FEATURES)
    sums = np.zeros((2, 1 + p + p * p))
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, p)
        y = batch.column("y").to_numpy()
        for c in (0, 1):
            own = x[y == c]
            sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    size = sums.shape[1]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([0, 1], size), pa.int32()), pa.array(np.tile(np.arange(size), 2), pa.int32()), pa.array(sums.ravel())], ["y", "at", "v"]
    )


def fit(feats: DataFrame, labels: DataFrame, pooled: float = POOLED, sphere: float = SPHERE) -> Model:
    """Learns from labels (doc_id, y in 0, 1); all of them count, and only sums reach the driver.

    With under two rows of a class the score is the smoothed share of class 1.
    """
    p = len(FEATURES)
    rows = feats.join(labels.select("doc_id", F.col("y").cast("int").alias("y")).filter("y in (0, 1)"), "doc_id").select("x", "y")
    sums = np.zeros((2, 1 + p + p * p))
    for r in rows.mapInArrow(_moments, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect():
        sums[r.y, r.at] = r.v
    n = sums[:, 0]
    if n.min() < 2:
        return Model(np.zeros(p), np.ones(p), [], [], [], constant=float((n[1] + 1) / (n.sum() + 2)))
    shift = sums[:, 1 : 1 + p].sum(0) / n.sum()
    second = sums[:, 1 + p :].reshape(2, p, p)
    scale = np.sqrt(np.maximum(np.diag(second.sum(0)) / n.sum() - shift**2, 1e-9))
    mean = [sums[c, 1 : 1 + p] / n[c] for c in (0, 1)]
    cov = [(second[c] / n[c] - np.outer(mean[c], mean[c])) / np.outer(scale, scale) for c in (0, 1)]
    whole = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    offset, factor = [], []
    for c in (0, 1):
        s = (1 - pooled) * cov[c] + pooled * whole
        s = (1 - sphere) * s + (sphere * np.trace(s) / p + 1e-6) * np.eye(p)
        low = np.linalg.cholesky(s)
        offset.append(float(np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum()))
        factor.append(np.linalg.inv(low))
    return Model(shift, scale, offset, [(mean[c] - shift) / scale for c in (0, 1)], factor)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])


def _select(batches: Iterator[pa.RecordBatch], model: Model, text: str, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in T.slices(batch, text):
            good = model.score(statistics(data, offsets)) >= least
            if good.any():
                yield batch.slice(lo, hi - lo).filter(pa.array(good))


def training_rows(labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, y of the rows that may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y"))
    return rows.filter(~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each input row.

    Null and empty texts have all statistics 0 and get the model's score for that; texts of any length are read whole;
    repeated rows get equal scores; labels without a document, of other values, or null are not learned from; a null id
    is not held out; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    feats = cut(features(docs, doc_id, text))
    model = fit(feats, training_rows(labels))
    scored = feats.mapInArrow(partial(_score, model=model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject; narrow but for the fit."""
    model = fit(cut(features(docs)), training_rows(labels))
    return docs.mapInArrow(partial(_select, model=model, text=text, least=threshold), docs.schema)


@register("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
