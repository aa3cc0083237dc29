"""Epoch and movement analytics.

One period holds one value per fixed-width slot, so its length is bounded by its
duration; samples are reduced to slots before anything here is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_us

EPOCH_MINUTES = 5


def slot_epochs(samples: DataFrame, period: Sequence[str], code: Column, tie: Sequence[str], ts: str = "ts", minutes: int = EPOCH_MINUTES) -> DataFrame:
    """Last code of every 5-minute slot; ``epoch_index`` counts slots from the period's first one, so holes keep their time."""
    slot = F.floor(epoch_us(ts) / F.lit(minutes * 60_000_000))
    s = samples.withColumn("_slot", slot).groupBy(*period, "_slot").agg(F.max_by(code, F.struct(*tie)).alias("phase"))
    return s.withColumn("epoch_index", (F.col("_slot") - F.min("_slot").over(Window.partitionBy(*period))).cast("int")).drop("_slot")


def with_previous(epochs: DataFrame, period: Sequence[str]) -> DataFrame:
    return epochs.withColumn("previous", F.lag("phase").over(Window.partitionBy(*period).orderBy("epoch_index")))


def fragmentation(epochs: DataFrame, period: Sequence[str]) -> DataFrame:
    """Both definitions: awake-to-sleep per hour asleep, and any change per hour recorded."""
    d = with_previous(epochs, period)
    g = d.groupBy(*period).agg(
        F.count_if((F.col("previous") == 4) & F.col("phase").isin(1, 2, 3)).alias("wakes"),
        F.count_if(F.col("phase") != F.col("previous")).alias("transitions"),
        F.count_if(F.col("phase") != 4).alias("_asleep"), F.count_if(F.col("phase") == 4).alias("_awake"), F.count("*").alias("n_epochs"),
    )
    hour = EPOCH_MINUTES / 60.0
    return g.select(
        *period, "wakes", "transitions", "n_epochs",
        (F.col("wakes") / F.nullif(F.col("_asleep") * hour, F.lit(0.0))).alias("per_sleep_hour"),
        (F.col("transitions") / (F.col("n_epochs") * hour)).alias("per_hour"),
        (F.col("_awake") / F.col("n_epochs") * 100).alias("awake_pct"),
    )


def transition_matrix(epochs: DataFrame, period: Sequence[str], by: Sequence[str] = (), states: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Counts and row-normalised probabilities of every state pair, within periods only; absent pairs read 0."""
    d = with_previous(epochs, period).where(F.col("previous").isNotNull())
    cells = [
        F.struct(
            F.lit(a).alias("from_phase"), F.lit(b).alias("to_phase"),
            F.count_if((F.col("previous") == a) & (F.col("phase") == b)).alias("n"),
            F.count_if(F.col("previous") == a).alias("_row"),
        )
        for a in states for b in states
    ]
    g = d.groupBy(*by).agg(F.array(*cells).alias("c")).select(*by, F.inline("c"))
    return g.withColumn("p", F.col("n") / F.nullif(F.col("_row"), F.lit(0))).drop("_row")


def phase_share(epochs: DataFrame, by: Sequence[str]) -> DataFrame:
    c = epochs.groupBy(*by, "phase").agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy(*by)) * 100)


def epoch_grid(epochs: DataFrame, period: Sequence[str], n_epochs: int) -> DataFrame:
    """Period x epoch matrix of phases."""
    return epochs.groupBy(*period).pivot("epoch_index", list(range(n_epochs))).agg(F.first("phase"))


def rem_latency(epochs: DataFrame, period: Sequence[str]) -> DataFrame:
    """Minutes from sleep onset to the first REM epoch."""
    w = Window.partitionBy(*period)
    d = epochs.withColumn("onset", F.min(F.when(F.col("phase").isin(1, 2, 3), F.col("epoch_index"))).over(w))
    g = d.groupBy(*period).agg(
        F.first("onset").alias("onset"),
        F.min(F.when((F.col("phase") == 3) & (F.col("epoch_index") >= F.col("onset")), F.col("epoch_index"))).alias("rem"),
    )
    return g.where(F.col("onset").isNotNull()).select(*period, "onset", "rem", ((F.col("rem") - F.col("onset")) * EPOCH_MINUTES).alias("latency_min"))


def sleep_cycles(epochs: DataFrame, period: Sequence[str]) -> DataFrame:
    """NREM-REM cycles: one row per completed cycle.

    A cycle closes on the first epoch after REM that is not REM, so closings are
    found with ``lag`` and numbered with a running sum; a cycle starts at the
    first sleeping epoch of its stretch and lasts until its last REM epoch ends.
    """
    w = Window.partitionBy(*period).orderBy("epoch_index")
    d = with_previous(epochs, period)
    close = F.coalesce((F.col("previous") == 3) & (F.col("phase") != 3), F.lit(False))
    d = d.withColumn("cycle", F.sum(close.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(*period, "cycle").agg(
        F.min(F.when(F.col("phase").isin(1, 2, 3), F.col("epoch_index"))).alias("_start"),
        (F.max("epoch_index") + 1).alias("_end"), F.max(F.col("phase") == 3).alias("_rem"),
    )
    return g.where("_rem").select(*period, "cycle", ((F.col("_end") - F.col("_start")) * EPOCH_MINUTES).cast("bigint").alias("minutes"))


def restlessness(movement: DataFrame, period: Sequence[str]) -> DataFrame:
    return movement.groupBy(*period).agg(F.count("*").alias("n"), F.avg(F.col("classification").isin(2, 3, 4).cast("double")).alias("restlessness"))


def movement_by_bin(movement: DataFrame, period: Sequence[str], bins: int = 8) -> DataFrame:
    """Mean class in equal positional parts of each period, then over periods."""
    w = Window.partitionBy(*period)
    pos = F.row_number().over(w.orderBy("movement_index")) - 1
    d = movement.withColumn("_pos", pos).withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= bins)
    d = d.withColumn("bin", F.least(F.floor(F.col("_pos") / F.floor(F.col("_n") / bins)), F.lit(bins - 1)))
    per = d.groupBy(*period, "bin").agg(F.avg("classification").alias("m"))
    return per.groupBy("bin").agg(F.avg("m").alias("intensity"), F.count("*").alias("n_periods"))


def stage_stats(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Readings per sleep stage: mean, median, population sd, quartiles, n (readings are quantised)."""
    hist = samples.groupBy(*by, value).agg(F.count("*").alias("_n"))
    n, v = F.col("_n"), F.col(value)
    q = lambda p: F.percentile(value, F.lit(p), F.col("_n"))
    g = hist.groupBy(*by).agg(
        F.sum("_n").alias("n"), (F.sum(n * v) / F.sum("_n")).alias("mean"), (F.sum(n * v * v) / F.sum("_n")).alias("_q"),
        q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"),
    )
    return g.withColumn("sd", F.sqrt(F.greatest(F.col("_q") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("_q")


def night_grid(samples: DataFrame, period: Sequence[str], value: str, minute: Column, bins: int = 120, width: int = 5) -> DataFrame:
    """Mean per fixed 5-minute bin from bedtime; holes inside are bridged linearly.

    Only measured bins are dealt and ordered; each then lists the hole up to the next one.
    """
    b = F.floor(minute / width)
    g = samples.withColumn("_b", b).where(F.col("_b").between(0, bins - 1)).groupBy(*period, "_b").agg(F.avg(value).alias("v"))
    w = Window.partitionBy(*period).orderBy("_b")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col("v").isNotNull(), F.struct("v", F.col("_b").alias("b")))
    g = g.withColumn("_0", F.last(known, True).over(back)).withColumn("_1", F.first(known, True).over(ahead)).withColumn("_next", F.lead("_b").over(w))
    full = g.withColumn("bin", F.explode(F.sequence(F.col("_b"), F.coalesce(F.col("_next") - 1, F.col("_b")))))
    v0, b0, v1, b1 = F.col("_0.v"), F.col("_0.b"), F.col("_1.v"), F.col("_1.b")
    own = F.when(F.col("bin") == F.col("_b"), F.col("v"))
    return full.select(*period, "bin", F.coalesce(own, v0 + (v1 - v0) * (F.col("bin") - b0) / (b1 - b0)).alias("value"))
