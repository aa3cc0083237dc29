"""Stateful control charts over slot means.

Samples are reduced to fixed slots first (a combining aggregate), so one entity
sends at most one row per slot into the state, however many samples it produces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.spc import ACTION_SIGMA, CUSUM_H, CUSUM_K, EWMA_LAMBDA

_STATE = "n BIGINT, mu DOUBLE, deviation DOUBLE, sigma DOUBLE, pos DOUBLE, neg DOUBLE, ewma DOUBLE, last_ms BIGINT, held_us ARRAY<BIGINT>, held ARRAY<DOUBLE>"
_OUT = "at_us BIGINT, value DOUBLE, cusum_pos DOUBLE, cusum_neg DOUBLE, ewma DOUBLE, level STRING"


def control_chart(slots: DataFrame, by: Sequence[str], ts: str = "ts", value: str = "value", baseline: int = 14, delay: str = "3 days", forget_days: int = 30) -> DataFrame:
    """CUSUM and EWMA per entity and metric with a baseline learned from the first values.

    Rows wait in the state until the watermark has passed them and are then applied in order of time, by a timer if
    no other row comes; rows of an equal time are applied in order of value.  So the result does not depend on how
    rows fall into micro-batches, as long as they come within ``delay``.  What waits is bounded by the slots of ``delay``.
    RED marks a CUSUM alarm, YELLOW an EWMA beyond its limit.  State is forgotten once event time is ``forget_days`` past
    the last row.
    """
    by = list(by)
    kinds = dict(slots.dtypes)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            n, mu, deviation, sigma, pos, neg, ewma, last, times, values = state.get
            waiting = list(zip(times, values))
        else:
            n, mu, deviation, sigma, pos, neg, ewma, last, waiting = 0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0, []
        if not state.hasTimedOut:
            for rows in batches:
                known = rows[rows["value"].notna()]
                waiting += zip(known["at_us"].astype("int64").tolist(), known["value"].astype(float).tolist())
        passed = state.getCurrentWatermarkMs()
        due = sorted(r for r in waiting if r[0] // 1000 < passed)
        waiting = sorted(r for r in waiting if r[0] // 1000 >= passed)
        out = []
        for at, x in due:
            last, n = at // 1000, n + 1
            ewma = x if n == 1 else EWMA_LAMBDA * x + (1 - EWMA_LAMBDA) * ewma
            if n <= baseline:  # Welford's update
                step = x - mu
                mu += step / n
                deviation += step * (x - mu)
                sigma = math.sqrt(deviation / n)
                sigma = sigma if sigma >= 1e-10 else 1.0
                continue
            pos = max(0.0, pos + x - mu - CUSUM_K * sigma)
            neg = max(0.0, neg - x + mu - CUSUM_K * sigma)
            spread = ACTION_SIGMA * sigma * math.sqrt(EWMA_LAMBDA / (2 - EWMA_LAMBDA) * (1 - (1 - EWMA_LAMBDA) ** (2 * n)))
            level = "RED" if max(pos, neg) > CUSUM_H * sigma else "YELLOW" if abs(ewma - mu) > spread else "OK"
            out.append((*key, at, x, pos, neg, ewma, level))
        if state.hasTimedOut and not due and not waiting:
            state.remove()
            return
        state.update((n, mu, deviation, sigma, pos, neg, ewma, last, [at for at, _ in waiting], [x for _, x in waiting]))
        wake = waiting[0][0] // 1000 if waiting else last + forget_days * 86_400_000
        state.setTimeoutTimestamp(max(wake, passed + 1))
        if out:
            yield pd.DataFrame(out, columns=[*by, *[c.split()[0] for c in _OUT.split(", ")]])

    keyed = ", ".join(f"{k} {kinds[k]}" for k in by)
    rows = slots.withWatermark(ts, delay).select(*by, ts, F.unix_micros(ts).alias("at_us"), F.col(value).cast("double").alias("value"))
    return rows.groupBy(*by).applyInPandasWithState(run, f"{keyed}, {_OUT}", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
