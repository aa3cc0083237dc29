"""Declared schemas of the sensor tables and the landing objects."""

from __future__ import annotations

# Table layouts, column order is the contract.
TABLES: dict[str, str] = {
    "heart_rate": "entity_id STRING, ts TIMESTAMP, ts_raw STRING, bpm INT, source STRING",
    "hrv": "entity_id STRING, ts TIMESTAMP, ts_raw STRING, rmssd DOUBLE, source STRING",
    "sleep_periods": (
        "entity_id STRING, period_id STRING, day DATE, type STRING, average_hrv DOUBLE, "
        "average_heart_rate DOUBLE, average_breath DOUBLE, total_sleep_duration INT, "
        "rem_sleep_duration INT, deep_sleep_duration INT, light_sleep_duration INT, awake_time INT, "
        "efficiency INT, latency INT, restless_periods INT, lowest_heart_rate INT, "
        "bedtime_start TIMESTAMP, bedtime_end TIMESTAMP, time_in_bed INT"
    ),
    "sleep_epochs": "entity_id STRING, period_id STRING, epoch_index INT, phase INT",
    "sleep_movement": "entity_id STRING, period_id STRING, movement_index INT, classification INT",
    "sleep_hr": "entity_id STRING, period_id STRING, ts TIMESTAMP, bpm INT",
    "sleep_daily": (
        "entity_id STRING, day DATE, score INT, total_sleep_duration INT, rem_sleep_duration INT, "
        "deep_sleep_duration INT, light_sleep_duration INT, awake_time INT, efficiency INT, latency INT, "
        "restless_periods INT, bedtime_start TIMESTAMP, bedtime_end TIMESTAMP, hr_lowest INT, "
        "hr_average DOUBLE, hrv_average DOUBLE, breath_average DOUBLE, temperature_delta DOUBLE"
    ),
    "readiness": (
        "entity_id STRING, day DATE, score INT, temperature_deviation DOUBLE, activity_balance INT, "
        "body_temperature INT, hrv_balance INT, previous_day_activity INT, previous_night INT, "
        "recovery_index INT, resting_heart_rate INT, sleep_balance INT"
    ),
    "activity": (
        "entity_id STRING, day DATE, score INT, active_calories INT, total_calories INT, steps INT, "
        "daily_movement INT, inactive_time INT, rest_time INT, low_activity_time INT, "
        "medium_activity_time INT, high_activity_time INT"
    ),
    "spo2": "entity_id STRING, day DATE, spo2_average DOUBLE, breathing_disturbance_index DOUBLE",
    "stress": "entity_id STRING, day DATE, stress_high INT, recovery_high INT, day_summary STRING",
    "resilience": "entity_id STRING, day DATE, level STRING, sleep_recovery DOUBLE, daytime_recovery DOUBLE, stress DOUBLE",
    "cardiovascular_age": "entity_id STRING, day DATE, vascular_age DOUBLE",
    "vo2_max": "entity_id STRING, day DATE, vo2_max DOUBLE",
    "sleep_time": "entity_id STRING, day DATE, optimal_start_offset INT, optimal_end_offset INT, recommendation STRING, status STRING",
    "workouts": "entity_id STRING, workout_id STRING, day DATE, activity STRING, calories DOUBLE, distance DOUBLE, start_datetime STRING, end_datetime STRING, intensity STRING, source STRING",
    "sessions": "entity_id STRING, session_id STRING, day DATE, type STRING, start_datetime STRING, end_datetime STRING, mood STRING",
    "tags": "entity_id STRING, tag_id STRING, day DATE, ts_raw STRING, tag_type STRING, text STRING",
    "rest_mode": "entity_id STRING, rest_mode_id STRING, start_day DATE, end_day DATE, start_time STRING, end_time STRING",
    "ring_config": "entity_id STRING, config_id STRING, color STRING, design STRING, firmware_version STRING, hardware_type STRING, size INT, set_up_at STRING",
    "personal_info": "entity_id STRING, age INT, weight DOUBLE, height DOUBLE, biological_sex STRING, email_key STRING",
    "external_steps": "entity_id STRING, day DATE, steps INT",
}

# The column or columns that identify one row.
KEYS: dict[str, tuple[str, ...]] = {
    "heart_rate": ("entity_id", "ts"),
    "hrv": ("entity_id", "ts"),
    "sleep_periods": ("entity_id", "period_id"),
    "sleep_epochs": ("entity_id", "period_id", "epoch_index"),
    "sleep_movement": ("entity_id", "period_id", "movement_index"),
    "sleep_hr": ("entity_id", "period_id", "ts"),
    "workouts": ("entity_id", "workout_id"),
    "sessions": ("entity_id", "session_id"),
    "tags": ("entity_id", "tag_id"),
    "rest_mode": ("entity_id", "rest_mode_id"),
    "ring_config": ("entity_id", "config_id"),
    "personal_info": ("entity_id",),
}

# Accepted ranges of measured columns, (low, high, null allowed).
RANGES: dict[str, tuple[float, float, bool]] = {
    "rmssd": (0, 300, True),
    "heart_rate": (25, 250, True),
    "spo2_average": (70, 100, True),
    "total_sleep_duration": (0, 86400, True),
    "efficiency": (0, 100, True),
    "temperature_deviation": (-5, 5, True),
    "p_value": (0, 1, False),
    "effect_size": (-50, 50, True),
}


def key_of(table: str) -> tuple[str, ...]:
    return KEYS.get(table, ("entity_id", "day"))


_SERIES = "STRUCT<timestamp: STRING, interval: INT, items: ARRAY<DOUBLE>>"

# Nested layouts of landed objects.
LANDING: dict[str, str] = {
    "sleep_periods": (
        "entity_id STRING, imported_at STRING, id STRING, day STRING, type STRING, average_hrv DOUBLE, "
        "average_heart_rate DOUBLE, average_breath DOUBLE, total_sleep_duration INT, rem_sleep_duration INT, "
        "deep_sleep_duration INT, light_sleep_duration INT, awake_time INT, efficiency INT, latency INT, "
        "restless_periods INT, lowest_heart_rate INT, bedtime_start STRING, bedtime_end STRING, time_in_bed INT, "
        f"hrv {_SERIES}, heart_rate {_SERIES}, sleep_phase_5_min STRING, movement_30_sec STRING"
    ),
    "readiness": (
        "entity_id STRING, imported_at STRING, day STRING, score INT, temperature_deviation DOUBLE, "
        "contributors STRUCT<activity_balance: INT, body_temperature: INT, hrv_balance: INT, "
        "previous_day_activity: INT, previous_night: INT, recovery_index: INT, resting_heart_rate: INT, sleep_balance: INT>"
    ),
    "sleep_daily": "entity_id STRING, imported_at STRING, day STRING, score INT",
    "activity": (
        "entity_id STRING, imported_at STRING, day STRING, score INT, active_calories INT, total_calories INT, "
        "steps INT, equivalent_walking_distance INT, sedentary_time INT, resting_time INT, low_activity_time INT, "
        "medium_activity_time INT, high_activity_time INT"
    ),
    "spo2": (
        "entity_id STRING, imported_at STRING, day STRING, spo2_percentage STRUCT<average: DOUBLE>, "
        "breathing_disturbance_index DOUBLE"
    ),
    "stress": "entity_id STRING, imported_at STRING, day STRING, stress_high INT, recovery_high INT, day_summary STRING",
    "resilience": (
        "entity_id STRING, imported_at STRING, day STRING, level STRING, "
        "contributors STRUCT<sleep_recovery: DOUBLE, daytime_recovery: DOUBLE, stress: DOUBLE>"
    ),
    "cardiovascular_age": "entity_id STRING, imported_at STRING, day STRING, vascular_age DOUBLE",
    "vo2_max": "entity_id STRING, imported_at STRING, day STRING, vo2_max DOUBLE",
    "sleep_time": (
        "entity_id STRING, imported_at STRING, day STRING, optimal_bedtime STRUCT<start_offset: INT, end_offset: INT>, "
        "recommendation STRING, status STRING"
    ),
    "heart_rate": "entity_id STRING, imported_at STRING, timestamp STRING, bpm INT, source STRING",
    "workouts": (
        "entity_id STRING, imported_at STRING, id STRING, day STRING, activity STRING, calories DOUBLE, distance DOUBLE, "
        "start_datetime STRING, end_datetime STRING, intensity STRING, source STRING"
    ),
    "sessions": "entity_id STRING, imported_at STRING, id STRING, day STRING, type STRING, start_datetime STRING, end_datetime STRING, mood STRING",
    "tags": "entity_id STRING, imported_at STRING, id STRING, day STRING, timestamp STRING, tag_type_code STRING, text STRING",
    "rest_mode": "entity_id STRING, imported_at STRING, id STRING, start_day STRING, end_day STRING, start_time STRING, end_time STRING",
    "ring_config": (
        "entity_id STRING, imported_at STRING, id STRING, color STRING, design STRING, firmware_version STRING, "
        "hardware_type STRING, size INT, set_up_at STRING"
    ),
    "personal_info": "entity_id STRING, imported_at STRING, age INT, weight DOUBLE, height DOUBLE, biological_sex STRING, email STRING",
}
