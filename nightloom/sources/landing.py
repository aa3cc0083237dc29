"""Nested landing objects to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import hash_prefix, lenient_ts
from . import schemas

DEFAULT_STEP = {"hrv": 300, "heart_rate": 5}


def read_landing(spark: SparkSession, path: str, stream: str) -> DataFrame:
    """One JSON object per line with a declared schema; missing keys become NULL, bad lines are left out (see :func:`land`)."""
    return (
        spark.read.schema(schemas.LANDING[stream] + ", _bad STRING")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
        .json(path).where(F.col("_bad").isNull()).drop("_bad")
    )


def split_lines(lines: DataFrame, stream: str, text: str = "value") -> DataFrame:
    """Parses lines once: their own columns, ``ok`` and the object ``row`` (null where ``ok`` is false); blank lines go.

    A line is bad if it is no JSON object or a value does not fit its declared type.
    """
    shape = schemas.LANDING[stream] + ", _bad STRING"
    parsed = F.from_json(text, shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    ok = F.col("_parsed").isNotNull() & F.col("_parsed._bad").isNull()
    kept = lines.where(F.trim(text) != "").withColumn("_parsed", parsed).withColumn("ok", ok)
    return kept.withColumn("row", F.when(F.col("ok"), F.col("_parsed").dropFields("_bad"))).drop("_parsed")


def land(spark: SparkSession, path: str, stream: str) -> tuple[DataFrame, DataFrame]:
    """The objects of one endpoint and its quarantined lines (file, line), from one read of the text.

    Both come from one table in the shared folder that one job writes, so no line can be in both or in neither.
    """
    from ..session import scratch_path

    target = scratch_path(spark, f"landing-{stream}")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    split_lines(lines, stream).write.partitionBy("ok").parquet(target)
    both = spark.read.parquet(target)
    return both.where("ok").select("row.*"), both.where("NOT ok").select("file", F.col("value").alias("line"))


def unpack_series(df: DataFrame, series: str, value: str, keep: list[str], default_step: int) -> DataFrame:
    """{timestamp, interval, items[]} to one row per item.

    NULL items and items of 0 or less go, and so does a series whose start cannot be read.
    """
    start = lenient_ts(F.col(f"{series}.timestamp"))
    step = F.coalesce(F.col(f"{series}.interval"), F.lit(default_step))
    return (
        df.select(*keep, start.alias("_start"), step.alias("_step"), F.posexplode(f"{series}.items").alias("pos", value))
        .where(F.col("_start").isNotNull() & (F.col(value) > 0))
        .select(*keep, F.timestamp_add("SECOND", F.col("pos") * F.col("_step"), F.col("_start")).alias("ts"), "pos", value)
    )


def unpack_digits(df: DataFrame, text: str, index: str, value: str, keep: list[str]) -> DataFrame:
    """Digit text to (index, digit) rows; other characters are skipped but keep their place."""
    return (
        df.select(*keep, F.posexplode(F.split(F.col(text), "")).alias(index, "_c"))
        .where(F.col("_c").rlike("^[0-9]$"))
        .select(*keep, index, F.col("_c").cast("int").alias(value))
    )


def period_tables(landed: DataFrame) -> dict[str, DataFrame]:
    """The five tables hidden in one landed period object."""
    df = landed.withColumnRenamed("id", "period_id").withColumn("day", F.col("day").try_cast("date"))
    keep = ["entity_id", "period_id", "imported_at"]
    periods = df.select(
        *[c for c in df.columns if c not in {"hrv", "heart_rate", "sleep_phase_5_min", "movement_30_sec", "bedtime_start", "bedtime_end"}],
        lenient_ts("bedtime_start").alias("bedtime_start"), lenient_ts("bedtime_end").alias("bedtime_end"),
    )
    hrv = unpack_series(df, "hrv", "rmssd", [*keep, "type"], DEFAULT_STEP["hrv"]).select(
        *keep, "ts", "rmssd", F.concat(F.lit("sleep_period:"), F.coalesce("type", F.lit("unknown"))).alias("source")
    )
    hr = unpack_series(df, "heart_rate", "bpm", keep, DEFAULT_STEP["heart_rate"]).select(*keep, "ts", F.col("bpm").cast("int").alias("bpm"))
    return {
        "sleep_periods": periods,
        "hrv": hrv,
        "sleep_hr": hr,
        "sleep_epochs": unpack_digits(df, "sleep_phase_5_min", "epoch_index", "phase", keep),
        "sleep_movement": unpack_digits(df, "movement_30_sec", "movement_index", "classification", keep),
    }


# Landed name of a column where it differs from the table's.
_RENAMES: dict[str, dict[str, str]] = {
    "readiness": {c: f"contributors.{c}" for c in (
        "activity_balance", "body_temperature", "hrv_balance", "previous_day_activity",
        "previous_night", "recovery_index", "resting_heart_rate", "sleep_balance")},
    "activity": {"daily_movement": "equivalent_walking_distance", "inactive_time": "sedentary_time", "rest_time": "resting_time"},
    "spo2": {"spo2_average": "spo2_percentage.average"},
    "resilience": {c: f"contributors.{c}" for c in ("sleep_recovery", "daytime_recovery", "stress")},
    "sleep_time": {"optimal_start_offset": "optimal_bedtime.start_offset", "optimal_end_offset": "optimal_bedtime.end_offset"},
    "heart_rate": {"ts_raw": "timestamp"},
    "workouts": {"workout_id": "id"},
    "sessions": {"session_id": "id"},
    "tags": {"tag_id": "id", "ts_raw": "timestamp", "tag_type": "tag_type_code"},
    "rest_mode": {"rest_mode_id": "id"},
    "ring_config": {"config_id": "id"},
}


def typed_table(landed: DataFrame, stream: str) -> DataFrame:
    """A flat landed object to its table layout; columns the object lacks are NULL."""
    have = set(landed.columns)
    out: list[Column] = []
    for field in (f.strip() for f in schemas.TABLES[stream].split(",")):
        name, kind = field.split(" ", 1)
        src = _RENAMES.get(stream, {}).get(name, name)
        if stream == "heart_rate" and name == "ts":
            c = lenient_ts("timestamp")
        elif stream == "personal_info" and name == "email_key":
            c = hash_prefix("email")
        elif src.split(".")[0] not in have:
            c = F.lit(None)
        else:
            c = F.col(src)
        out.append(c.try_cast(kind).alias(name))
    return landed.select(*out, "imported_at")
