"""Data-quality operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_violations(df: DataFrame, ranges: dict[str, tuple[float | None, float | None, bool]], keys: Sequence[str]) -> DataFrame:
    """All failing cells, not just the first: one row per (row, column) outside its range."""
    checks = []
    for name, (low, high, nullable) in ranges.items():
        v = F.col(name).cast("double")
        problem = F.when(F.col(name).isNull() | F.isnan(v), F.lit(None) if nullable else F.lit("missing"))
        if low is not None:
            problem = problem.when(v < low, f"below {low:g}")
        if high is not None:
            problem = problem.when(v > high, f"above {high:g}")
        checks.append(F.struct(F.lit(name).alias("column_name"), v.alias("value"), problem.alias("problem")))
    return df.select(*keys, F.inline(F.array(*checks))).where(F.col("problem").isNotNull())


def split_valid(df: DataFrame, ranges: dict[str, tuple[float | None, float | None, bool]]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows of one frame."""
    ok = F.lit(True)
    for name, (low, high, nullable) in ranges.items():
        v = F.col(name).cast("double")
        inside = F.lit(True)
        if low is not None:
            inside = inside & (v >= low)
        if high is not None:
            inside = inside & (v <= high)
        missing = F.col(name).isNull() | F.isnan(v)
        ok = ok & F.when(missing, F.lit(nullable)).otherwise(inside)
    return df.where(ok), df.where(~ok)


def require_columns(df: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """(present, absent), from the schema alone."""
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]


def completeness(signals: DataFrame, entity: str = "entity_id", day: str = "day") -> DataFrame:
    """Share of the calendar on which each metric of each entity has a value."""
    span = signals.agg((F.datediff(F.max(day), F.min(day)) + 1).cast("bigint").alias("d"))
    per = signals.where(F.col("value").isNotNull()).groupBy(entity, "metric").agg(F.count("*").alias("n_days"))
    out = per.withColumn("calendar_days", span.scalar())
    return out.withColumn("completeness", F.col("n_days") / F.col("calendar_days"))


def missing_share(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), limit: float = 0.5) -> DataFrame:
    """NULL share per metric and whether it stays within the limit: one pass, one row, then turned long."""
    agg = df.groupBy(*by).agg(*[F.avg(F.col(m).isNull().cast("double")).alias(m) for m in metrics])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("missing_share")) for m in metrics])
    return agg.select(*by, F.inline(pairs)).withColumn("usable", F.col("missing_share") <= limit)


def period_day_counts(periods: DataFrame, by: Sequence[str], entity: str = "entity_id", day: str = "day") -> DataFrame:
    """Rows against distinct days: naps inflate n."""
    per = periods.groupBy(*by, entity, day).agg(F.count("*").alias("_n"))
    days = per.groupBy(*by, day).agg(F.sum("_n").alias("_n"), F.count("*").alias("_e"))
    return days.groupBy(*by).agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_days"), F.sum("_e").alias("n_entity_days"))


def guarded(n: str, k: int, *stats: str):
    """Statistics only where the sample is large enough, with a status beside them."""
    enough = F.col(n) >= k
    return [F.when(enough, F.col(s)).alias(s) for s in stats] + [F.when(enough, "ok").otherwise("insufficient").alias("status")]
