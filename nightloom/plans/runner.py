"""Run many plans in one application; one that fails leaves the others alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .registry import QUERIES, Plan


def run_plans(spark: SparkSession, folder: str, plans: dict[str, Plan] | None = None, out: str | None = None) -> DataFrame:
    """Write each plan's result under ``out`` and return a status row per plan."""
    rows = []
    for name, plan in (plans or QUERIES).items():
        try:
            df = plan(spark, folder)
            if out:
                df.write.mode("overwrite").parquet(f"{out}/{name}")
                n = spark.read.parquet(f"{out}/{name}").count()
            else:
                seen = Observation()
                df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
                n = seen.get["n"]
            rows.append((name, True, n, None))
        except Exception as err:  # isolation is the point: the status row carries the reason
            rows.append((name, False, None, str(err)))
    return spark.createDataFrame(rows, "plan STRING, ok BOOLEAN, n_rows BIGINT, error STRING")


def assert_some_passed(status: DataFrame, strict: bool = False) -> None:
    """Fail when nothing passed, or with ``strict`` when anything failed."""
    bad = status.where("NOT ok").count()
    if bad and (strict or status.where("ok").isEmpty()):
        raise RuntimeError(f"{bad} plans failed")
