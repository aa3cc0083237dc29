"""Periodograms: irregular samples by combining sums on a fixed grid of frequencies, regular periods by one transform each."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial, reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
#: Samples that one array holds, samples times all frequencies that are in memory at once, and series in one batch of sums.
BLOCK, CHUNK, SERIES = 4096, 512, 64
#: Sums over (centred) samples at one frequency: y cos, y sin, cos cos, sin sin, cos sin.
SUMS = ["yc", "ys", "cc", "ss", "cs"]


def _sums(batches: Iterator[pa.RecordBatch], by: Sequence[str], freqs: Sequence[float]) -> Iterator[pa.RecordBatch]:
    """Sums over the samples of each row's ``_c`` (t, y) at every frequency, one row each; y is centred by the row's ``my``."""
    w = TWO_PI * np.asarray(freqs, dtype=float)
    for batch in batches:
        for lo in range(0, batch.num_rows, SERIES):
            rows = batch.slice(lo, SERIES)
            cells = rows.column("_c")
            ends, t, y = np.asarray(cells.offsets), np.asarray(cells.values.field("t")), np.asarray(cells.values.field("y"))
            mean = np.asarray(rows.column("my"))
            out = np.zeros((len(SUMS), rows.num_rows, len(w)))
            for i in range(rows.num_rows):
                for a in range(ends[i], ends[i + 1], CHUNK):
                    part = slice(a, min(a + CHUNK, ends[i + 1]))
                    c = np.outer(t[part], w)
                    c, s, v = np.cos(c), np.sin(c), y[part] - mean[i]
                    out[:, i] += v @ c, v @ s, (c * c).sum(0), (s * s).sum(0), (c * s).sum(0)
            at = np.repeat(np.arange(rows.num_rows), len(w))
            keep = [rows.column(c).take(pa.array(at)) for c in [*by, "yy"]]
            grid = [pa.array(np.tile(np.arange(len(w), dtype=np.int32), rows.num_rows)), pa.array(np.tile(np.asarray(freqs, dtype=float), rows.num_rows))]
            yield pa.RecordBatch.from_arrays([*keep, *grid, *(pa.array(x.ravel()) for x in out)], [*by, "yy", "k", "freq", *SUMS])


def lomb_scargle(df: DataFrame, value: str, seconds: Column, by: Sequence[str], freqs: Sequence[float], min_n: int = 20) -> DataFrame:
    """Normalised power of irregular samples at each frequency (Hz).

    The method needs five sums over (series, frequency).  Samples, not samples
    times frequencies, are dealt: a series of up to ``BLOCK`` samples travels as
    one array, a longer one as many, whose sums are added, so no series has to
    meet in one task.  ``seconds`` should count from a nearby origin to keep the
    phases precise.
    """
    by = list(by)
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_y"), seconds.cast("double").alias("_t"))
    moments = [F.count("*").alias("n"), F.avg("_y").alias("my"), (F.count("*") * F.var_pop("_y")).alias("yy")]
    cells = F.collect_list(F.when(F.col("_t").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_y").alias("y")))).alias("_c")
    long = d.groupBy(*by).agg(*moments).where((F.col("n") > BLOCK) & (F.col("n") >= min_n))
    long = long.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "n", "my", "yy")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)], F.lit(True))
    short = d.join(long, same, "left_anti").groupBy(*by).agg(*moments, cells).where((F.col("n") <= BLOCK) & (F.col("n") >= min_n))
    block = F.pmod(F.xxhash64("_t", "_y"), F.ceil(F.col("n") / BLOCK)).alias("block")
    long = d.join(long, same).select(*by, "my", "yy", "_t", "_y", block).groupBy(*by, "block").agg(F.first("my").alias("my"), F.first("yy").alias("yy"), cells)

    kinds = dict(d.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + (", " if by else "") + "yy double, k int, freq double, " + ", ".join(f"{c} double" for c in SUMS)
    sums = lambda x: x.select(*by, "my", "yy", "_c").mapInArrow(partial(_sums, by=by, freqs=list(freqs)), schema)
    g = sums(short).unionByName(sums(long).groupBy(*by, "k", "freq").agg(F.first("yy").alias("yy"), *[F.sum(c).alias(c) for c in SUMS]))
    th = F.atan2(2 * F.col("cs"), F.col("cc") - F.col("ss")) / 2
    g = g.withColumn("u", F.cos(th)).withColumn("v", F.sin(th))
    u, v = F.col("u"), F.col("v")
    yc, ys = u * F.col("yc") + v * F.col("ys"), u * F.col("ys") - v * F.col("yc")
    cc = u * u * F.col("cc") + 2 * u * v * F.col("cs") + v * v * F.col("ss")
    ss = u * u * F.col("ss") - 2 * u * v * F.col("cs") + v * v * F.col("cc")
    nz = lambda x: F.nullif(x, F.lit(0.0))
    return g.select(*by, "k", "freq", ((yc * yc / nz(cc) + ys * ys / nz(ss)) / nz(F.col("yy"))).alias("power"))


def linspace(a: float, b: float, n: int) -> list[float]:
    return [a + (b - a) * i / (n - 1) for i in range(n)]


def band_shares(spectrum: DataFrame, by: Sequence[str], split: tuple[float, float] = (0.002, 0.0035)) -> DataFrame:
    """Trapezoid power below, between and above the two split frequencies, shares and low/high ratio."""
    band = F.when(F.col("freq") < split[0], "vlf").when(F.col("freq") < split[1], "lf").otherwise("hf")
    d = spectrum.withColumn("band", band)
    w = Window.partitionBy(*by, "band").orderBy("k")
    d = d.withColumn("area", (F.col("power") + F.lag("power").over(w)) / 2 * (F.col("freq") - F.lag("freq").over(w)))
    g = d.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("band") == b, F.col("area"))), F.lit(0.0)).alias(b) for b in ("vlf", "lf", "hf")])
    total = F.nullif(F.col("vlf") + F.col("lf") + F.col("hf"), F.lit(0.0))
    return g.select(*by, *[(F.col(b) / total * 100).alias(f"{b}_pct") for b in ("vlf", "lf", "hf")], (F.col("lf") / F.nullif(F.col("hf"), F.lit(0.0))).alias("lf_hf"))


def periodogram(df: DataFrame, value: str, by: Sequence[str], index: str, step_min: float = 5.0, low_min: float = 30.0, high_min: float = 180.0, min_n: int = 10) -> DataFrame:
    """One-sided power of every period at the Fourier frequencies whose period lies in [low, high] minutes.

    ``index`` counts slots from the start of a period, so the grid is true to time; a slot without a value adds nothing
    after centring.  A period's slots, which its duration bounds, travel as one array, and one transform gives all
    frequencies: rows are linear in slots.
    """
    by = list(by)
    cells = F.sort_array(F.collect_list(F.struct(F.col(index).cast("int").alias("i"), F.col(value).cast("double").alias("v"))))
    rows = df.where(F.col(value).isNotNull()).groupBy(*by).agg(cells.alias("_c")).where(F.size("_c") >= min_n)
    rows = rows.select(*by, F.transform("_c", lambda c: c["i"]).alias("_i"), F.transform("_c", lambda c: c["v"]).alias("_v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                at, v = np.asarray(r["_i"]), np.asarray(r["_v"], dtype=float)
                n = int(at[-1]) + 1
                grid = np.zeros(n)
                grid[at] = v - v.mean()
                k = np.arange(max(math.ceil(n * step_min / high_min), 1), min(math.floor(n * step_min / low_min), n // 2) + 1)
                power = np.abs(np.fft.rfft(grid)[k]) ** 2 * np.where(2 * k == n, 1.0, 2.0) * (step_min * 60) / n
                out.append(pd.DataFrame({**{c: [r[c]] * len(k) for c in by}, "n": n, "k": k, "period_min": n * step_min / k, "power": power}))
            if out:
                yield pd.concat(out)

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n bigint, k bigint, period_min double, power double")


def top_peaks(spectrum: DataFrame, by: Sequence[str], k: int = 3) -> DataFrame:
    """Strongest k periods per series; place 1 is the dominant one."""
    w = Window.partitionBy(*by).orderBy(F.round("power", 6).desc(), "k")
    return spectrum.where(F.col("power") > 0).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def peak_summary(peaks: DataFrame, by: Sequence[str] = (), width: int = 5, k: int = 5) -> DataFrame:
    """Peaks binned to the nearest 5 minutes: mean power, count, strongest k bins."""
    b = (F.bround(F.round("period_min", 1) / width) * width).cast("int")
    g = peaks.groupBy(*by, b.alias("period_bin")).agg(F.avg("power").alias("mean_power"), F.count("*").alias("n"))
    if not by:
        return g.orderBy(F.desc("mean_power"), "period_bin").limit(k)
    w = Window.partitionBy(*by).orderBy(F.round("mean_power", 6).desc(), "period_bin")
    return g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def spectral_entropy(spectrum: DataFrame, by: Sequence[str]) -> DataFrame:
    """Normalised flatness of a power spectrum."""
    w = Window.partitionBy(*by)
    p = spectrum.where(F.col("power") > 0).withColumn("_p", F.col("power") / F.sum("power").over(w))
    g = p.groupBy(*by).agg(F.count("*").alias("n_bins"), (-F.sum(F.col("_p") * F.log2("_p"))).alias("_h"))
    return g.where(F.col("n_bins") > 1).select(*by, "n_bins", (F.col("_h") / F.log2("n_bins")).alias("spectral_entropy"))
