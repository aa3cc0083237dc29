"""Composite scores, weekly comparisons and sleep summaries over daily frames."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .windows import roll_mean, roll_slope, series, trailing, unit_sd

# Population norms, milestones, thresholds and weights.
NORMS = {"rmssd": (42.0, 15.0), "sleep_hr": (65.0, 10.0), "spo2": (97.5, 1.0), "awake_hr": (75.0, 10.0)}
MILESTONES = {6: (20, 80), 12: (25, 75), 24: (30, 72), 36: (35, 70)}
ALLOSTATIC = {
    "sleep_hr": (">", 80), "rmssd": ("<", 15), "efficiency": ("<", 85), "temp_deviation": ("abs>", 0.5),
    "spo2": ("<", 95.0), "deep_pct": ("<", 10.0), "rem_pct": ("<", 15.0),
}
DYSFUNCTION_WEIGHTS = {"rmssd": 0.25, "dfa": 0.15, "dip": 0.20, "hr_recovery": 0.15, "cv_age": 0.10, "spo2": 0.15}
ACTIVITY_WEIGHTS = {"temp": 0.25, "spo2": 0.20, "hrv": 0.25, "frag": 0.15, "recovery": 0.15}
CARDIO_WEIGHTS = {"hr": 0.25, "hrv": 0.25, "dip": 0.15, "spo2": 0.15, "cv_age": 0.20}
STREAM_WEIGHTS = {"temperature": 0.25, "spo2": 0.15, "hrv": 0.20, "sleep_frag": 0.15, "resting_hr": 0.15, "activity": 0.10}
AIRWAY_WEIGHTS = {"slope": 0.30, "variability": 0.20, "desaturation": 0.20, "breathing": 0.15, "decoupling": 0.15}
SLEEP_NORMS = {
    "general": {"deep_pct": (13.0, 23.0), "rem_pct": (20.0, 25.0), "efficiency": (85.0, 100.0), "total_hours": (7.0, 9.0)},
    "post_transplant": {"deep_pct": (8.0, 15.0), "rem_pct": (10.0, 18.0), "efficiency": (70.0, 82.0)},
    "post_stroke": {"deep_pct": (10.0, 18.0), "rem_pct": (12.0, 20.0), "efficiency": (72.0, 85.0)},
}


def weighted_available(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the parts that are present; NULL when none is."""
    total = known = None
    for name, c in parts.items():
        w = weights[name]
        t, k = F.coalesce(c * w, F.lit(0.0)), F.when(c.isNotNull(), w).otherwise(0.0)
        total, known = (t, k) if total is None else (total + t, known + k)
    return F.when(known > 0, total / known)


def weighted_neutral(parts: dict[str, Column], weights: dict[str, float], neutral: float = 50.0) -> Column:
    """Weighted sum in which a missing part counts as neutral."""
    out = None
    for name, c in parts.items():
        t = F.coalesce(c, F.lit(neutral)) * weights[name]
        out = t if out is None else out + t
    return out


def _down(c: str, start: float, span: float) -> Column:
    """0 at ``start``, 100 once ``span`` below it."""
    return S.clip((F.lit(start) - F.col(c)) / span * 100, 0, 100)


def dysfunction_index(daily: DataFrame) -> Column:
    """Autonomic severity 0-100 from the daily columns rmssd, dfa_alpha1, hr_dip_pct, awake_hr, cv_age_delta, spo2."""
    return weighted_available({
        "rmssd": 100 - S.norm_score("rmssd", *NORMS["rmssd"]), "dfa": S.clip(F.abs(F.col("dfa_alpha1") - 1.0) / 0.5 * 100, 0, 100),
        "dip": S.clip(100 - F.col("hr_dip_pct") / 15.0 * 100, 0, 100), "hr_recovery": S.clip(S.norm_score("awake_hr", *NORMS["awake_hr"]), 0, 100),
        "cv_age": S.clip(F.col("cv_age_delta") / 15.0 * 100, 0, 100), "spo2": _down("spo2", NORMS["spo2"][0], 3.0),
    }, DYSFUNCTION_WEIGHTS)


def activity_score(by: Sequence[str] = ("entity_id",), day: str = "day") -> Column:
    """Flare activity 0-100 from 7-row trends of temp_deviation, spo2, rmssd, awake_pct and strain_ratio (needs column ``rn``)."""
    w = trailing(by, 7, day)
    slope = lambda c: roll_slope(c, "rn", w, 7)
    return weighted_available({
        "temp": S.clip(roll_mean("temp_deviation", w, 3) * 100, 0, 100), "spo2": S.clip(-slope("spo2") / 0.5 * 100, 0, 100),
        "hrv": S.clip(-slope("rmssd") * 100, 0, 100), "frag": S.clip(slope("awake_pct") / 2.0 * 100, 0, 100),
        "recovery": S.clip((roll_mean("strain_ratio", w, 3) - 1.0) / 2.0 * 100, 0, 100),
    }, ACTIVITY_WEIGHTS)


def recovery_index(event: date, as_of: date) -> Column:
    """Mean of rmssd, sleep_hr and efficiency against the milestone line at ``as_of`` (0-100)."""
    months = F.lit(S.months_between_event(as_of, event))
    (r0, h0), (r1, h1) = MILESTONES[24], MILESTONES[36]
    rmssd = S.pinned_milestone(months, (24, float(r0)), (36, float(r1)))
    hr = S.pinned_milestone(months, (24, float(h0)), (36, float(h1)))
    parts = {
        "r": S.clip(F.col("rmssd") / rmssd * 100, 0, 100), "h": S.clip(hr / F.nullif(F.col("sleep_hr"), F.lit(0.0)) * 100, 0, 100),
        "e": S.clip(F.col("efficiency") / 85.0 * 100, 0, 100),
    }
    return weighted_available(parts, {"r": 1.0, "h": 1.0, "e": 1.0})


def cardio_risk() -> Column:
    return weighted_available({
        "hr": S.linear_score("sleep_hr", 60, 40), "hrv": 100 - S.norm_score("rmssd", *NORMS["rmssd"]),
        "dip": S.clip(100 - F.col("hr_dip_pct") / 15.0 * 100, 0, 100), "spo2": _down("spo2", NORMS["spo2"][0], 3.0),
        "cv_age": S.clip(F.col("cv_age_delta") / 15.0 * 100, 0, 100),
    }, CARDIO_WEIGHTS)


def exceedance_count(limits: dict[str, tuple[str, float]] = ALLOSTATIC) -> Column:
    """Number of thresholds exceeded; a missing value exceeds nothing."""
    out = F.lit(0)
    for c, (kind, limit) in limits.items():
        v = F.abs(F.col(c)) if kind.startswith("abs") else F.col(c)
        hit = v > limit if kind.endswith(">") else v < limit
        out = out + F.coalesce(hit.cast("int"), F.lit(0))
    return out


def exceedance_of_means(daily: DataFrame, by: Sequence[str], limits: dict[str, tuple[str, float]] = ALLOSTATIC) -> DataFrame:
    """The same count over each entity's overall means."""
    g = daily.groupBy(*by).agg(*[F.avg(F.abs(c) if k.startswith("abs") else F.col(c)).alias(c) for c, (k, _) in limits.items()])
    return g.withColumn("load", exceedance_count({c: (k.removeprefix("abs"), v) for c, (k, v) in limits.items()}))


def response_to_baseline(metrics: Sequence[str], baseline: Column, by: Sequence[str] = ("entity_id",), min_n: int = 5) -> Column:
    """Mean |z| over metrics, z against the baseline rows only."""
    w = Window.partitionBy(*by)
    total = known = F.lit(0.0)
    for m in metrics:
        base = F.when(baseline, F.col(m))
        sd = F.stddev_samp(base).over(w)
        z = F.abs(F.col(m) - F.avg(base).over(w)) / F.when(sd.isNull() | (sd == 0), 0.01).otherwise(sd)
        z = F.when(F.count(base).over(w) >= min_n, z)
        total, known = total + F.coalesce(z, F.lit(0.0)), known + F.when(z.isNotNull(), 1.0).otherwise(0.0)
    return F.when(known > 0, total / known)


def biomarker_frame(daily: DataFrame, event: date, as_of: date, treatment: date, by: Sequence[str] = ("entity_id",), day: str = "day") -> DataFrame:
    """All six daily composites side by side."""
    d = daily.withColumn("rn", F.row_number().over(series(by, day)))
    return d.select(
        *by, day, dysfunction_index(d).alias("dysfunction"), activity_score(by, day).alias("activity"), recovery_index(event, as_of).alias("recovery"),
        response_to_baseline(["rmssd", "sleep_hr", "efficiency", "temp_deviation", "spo2"], F.col(day) < F.lit(treatment), by).alias("response"),
        cardio_risk().alias("cardio_risk"), exceedance_count().alias("allostatic_load"),
    )


def stream_composite(daily: DataFrame, streams: dict[str, tuple[Column, int]], by: Sequence[str] = ("entity_id",), day: str = "day", weights: dict[str, float] = STREAM_WEIGHTS, baseline_days: int = 14) -> DataFrame:
    """z x 25 + 50 per stream against its first calendar days (up to first + 14), missing as 50, weighted; and the 7-row mean.

    ``streams`` maps a stream to (column, +1 when higher is worse or -1).
    """
    w = Window.partitionBy(*by)
    d = daily.withColumn("_base", F.col(day) <= F.date_add(F.min(day).over(w), baseline_days))
    parts = {}
    for name, (c, sign) in streams.items():
        base = F.when(F.col("_base"), c)
        z = (c - F.avg(base).over(w)) / unit_sd(F.stddev_samp(base).over(w)) * sign
        parts[name] = S.clip(z * 25 + 50, 0, 100)
    d = d.withColumn("composite", weighted_neutral(parts, {k: weights[k] for k in streams})).drop("_base")
    return d.withColumn("composite_7d", roll_mean("composite", trailing(by, 7, day), 3))


# Desaturation and breathing knots of the airway risk score.
CONCERN_SLOPE = -0.02


def airway_risk(stats: DataFrame) -> DataFrame:
    """Weighted airway risk from per-entity slope (%/day), cv_pct, desat_pct, mean_bdi and hr coupling r."""
    ratio = F.abs(F.col("slope") / CONCERN_SLOPE)
    parts = {
        "slope": F.when(F.col("slope") >= 0, 0.0).when(F.col("slope") >= CONCERN_SLOPE, F.least(ratio * 50, F.lit(100.0))).when(F.col("slope").isNotNull(), F.least(50 + ratio * 25, F.lit(100.0))),
        "variability": S.piecewise("cv_pct", [(0.5, 0), (1.0, 50), (2.0, 100)]),
        "desaturation": S.piecewise("desat_pct", [(0, 0), (5, 40), (15, 70), (35, 100)]),
        "breathing": F.coalesce(S.piecewise("mean_bdi", [(0, 0), (5, 30), (15, 70), (30, 100)]), F.lit(25.0)),
        "decoupling": F.coalesce(S.piecewise("r", [(-0.3, 0), (0.0, 50), (0.5, 100)]), F.lit(25.0)),
    }
    d = stats.withColumn("airway_risk", weighted_neutral(parts, AIRWAY_WEIGHTS, 0.0))
    return d.withColumn("level", S.named_band("airway_risk", "composite_risk"))


def combined_risk(df: DataFrame, systemic: str = "systemic", airway: str = "airway_risk", spo2: str = "spo2_mean") -> DataFrame:
    """0.7 systemic + 0.3 airway, the airway part raised when mean saturation is low."""
    factor = F.when(F.col(spo2) < 95, 1.5).when(F.col(spo2) < 96, 1.2).otherwise(1.0)
    score = F.coalesce(F.col(systemic) * 0.7 + F.col(airway) * 0.3 * factor, F.col(systemic))
    return df.withColumn("combined", score).withColumn("combined_level", F.when(F.col("combined") > 60, "HIGH").when(F.col("combined") > 40, "MODERATE").otherwise("LOW"))


def feature_importance(parts: DataFrame) -> DataFrame:
    """Blend of |point-biserial r|, mutual information, |composite r| and capped |d|."""
    score = (
        0.3 * F.coalesce(F.abs("r_flag"), F.lit(0.0)) + 0.3 * F.coalesce(F.col("mi"), F.lit(0.0))
        + 0.2 * F.coalesce(F.abs("r_composite"), F.lit(0.0)) + 0.2 * F.least(F.coalesce(F.abs("d"), F.lit(0.0)) / 2, F.lit(1.0))
    )
    return parts.withColumn("importance", score)


# --- weekly tracker ----------------------------------------------------------

def weekly_compare(signals: DataFrame, as_of: date, by: Sequence[str] = ("entity_id", "metric"), day: str = "day", value: str = "value") -> DataFrame:
    """The 7 days up to ``as_of`` against the 7 before."""
    this0, last0 = as_of - timedelta(days=6), as_of - timedelta(days=13)
    new, old = F.when(F.col(day) >= F.lit(this0), F.col(value)), F.when(F.col(day) < F.lit(this0), F.col(value))
    g = signals.where(F.col(day).between(F.lit(last0), F.lit(as_of))).groupBy(*by).agg(
        F.avg(new).alias("this_mean"), F.avg(old).alias("last_mean"), F.count(new).alias("n_this"), F.count(old).alias("n_last")
    )
    delta = F.col("this_mean") - F.col("last_mean")
    pct = F.when(F.col("last_mean") != 0, delta / F.abs("last_mean") * 100).when(F.col("last_mean") == 0, 0.0)
    return g.withColumn("delta", delta).withColumn("pct", F.when(delta.isNotNull(), pct))


def weekly_status(weekly: DataFrame, metric_defs: DataFrame) -> DataFrame:
    """Direction and traffic light from the registry's polarity and limits."""
    d = weekly.join(metric_defs, "metric")
    trend = S.change_direction("delta", "pct", F.col("higher_is_better"))
    d = d.withColumn("direction", F.when(F.col("delta").isNull(), "no_data").otherwise(trend))
    lim = [F.col(c) for c in ("normal_low", "normal_high", "critical_low", "critical_high")]
    moved = S.traffic_light("this_mean", "direction", "pct", *lim)
    alone = F.when(S.outside_limits(F.col("this_mean"), lim[2], lim[3]), "critical").when(F.col("this_mean").between(lim[0], lim[1]), "good").otherwise("warning")
    return d.withColumn("status", F.when(F.col("this_mean").isNull(), "warning").when(F.col("last_mean").isNull(), alone).otherwise(moved))


def summary_lines(status: DataFrame, by: Sequence[str] = ("entity_id",), limit: int = 5) -> DataFrame:
    """Up to two critical, two improving and one declining sentence per entity, biggest movers first."""
    size = F.abs("pct")
    kind = F.when(F.col("status") == "critical", 1).when(F.col("direction") == "improving", 2).when(F.col("direction") == "declining", 3)
    d = status.withColumn("kind", kind).where(F.col("kind").isNotNull() & F.col("pct").isNotNull())
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "kind").orderBy(size.desc(), "metric")))
    d = d.where(F.col("_k") <= F.when(F.col("kind") == 3, 1).otherwise(2))
    text = (
        F.when(F.col("kind") == 1, F.format_string("[!] %s: weekly mean %.1f, %+.1f%% on the week before (%s)", "metric", "this_mean", "pct", "direction"))
        .when(F.col("kind") == 2, F.format_string("[+] %s: weekly mean %.1f, better by %+.1f%%", "metric", "this_mean", "pct"))
        .otherwise(F.format_string("[-] %s: weekly mean %.1f, worse by %+.1f%%", "metric", "this_mean", "pct"))
    )
    d = d.withColumn("line", text).withColumn("line_no", F.row_number().over(Window.partitionBy(*by).orderBy("kind", "_k")))
    return d.where(F.col("line_no") <= limit).select(*by, "line_no", "line")


def event_baseline_compare(signals: DataFrame, event: date, as_of: date, by: Sequence[str] = ("entity_id", "metric"), days: int = 14, day: str = "day", value: str = "value") -> DataFrame:
    """Mean of the 14 days before the event against this week."""
    before = F.when((F.col(day) >= F.lit(event - timedelta(days=days))) & (F.col(day) < F.lit(event)), F.col(value))
    now = F.when(F.col(day).between(F.lit(as_of - timedelta(days=6)), F.lit(as_of)), F.col(value))
    g = signals.groupBy(*by).agg(F.avg(before).alias("baseline"), F.avg(now).alias("current"), F.count(before).alias("n_baseline"), F.count(now).alias("n_current"))
    return g.withColumn("pct", (F.col("current") - F.col("baseline")) / F.nullif(F.abs("baseline"), F.lit(0.0)) * 100)


# --- sleep summaries ---------------------------------------------------------

def sleep_timing(nights: DataFrame, by: Sequence[str] = ("entity_id",), day: str = "day", midpoint: str = "midpoint") -> DataFrame:
    """Weekday and weekend midpoints, social jet lag, CV, and first against second half."""
    from .windows import first_half

    d = nights.where(F.col(midpoint).isNotNull()).withColumn("_w", S.is_weekend_night(day)).withColumn("_h", first_half(by, day))
    m = F.col(midpoint)
    g = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.when(~F.col("_w"), m)).alias("weekday"), F.avg(F.when(F.col("_w"), m)).alias("weekend"),
        (F.stddev_samp(m) / F.nullif(F.avg(m), F.lit(0.0)) * 100).alias("cv_pct"), F.avg(F.when(F.col("_h"), m)).alias("first_half"), F.avg(F.when(~F.col("_h"), m)).alias("second_half"),
    )
    return g.withColumn("social_jet_lag", F.abs(F.col("weekend") - F.col("weekday")))


def recovery_indicators(nights: DataFrame, rem: str, deep: str, hours: str, by: Sequence[str] = ("entity_id",), day: str = "day", deep_floor: float = 13.0, target: float = 7.0) -> DataFrame:
    """Rebound after low nights, adequacy, debt, stability and latest value."""
    w, whole = series(by, day), Window.partitionBy(*by)
    r = F.col(rem)
    d = nights.withColumn("_m", F.avg(r).over(whole)).withColumn("_s", F.stddev_samp(r).over(whole)).withColumn("_next", F.lead(rem).over(w))
    low = (r < F.col("_m") - F.col("_s")) & F.col("_next").isNotNull()
    back = low & (F.col("_next") > F.col("_m") + F.col("_s"))
    g = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(low).alias("low_nights"), F.count_if(back).alias("rebounds"),
        F.avg(F.when(F.col(deep).isNotNull(), (F.col(deep) >= deep_floor).cast("double"))).alias("_a"),
        F.sum(F.col(hours) - target).alias("debt_hours"), (F.avg(F.col(hours) - target) * 60).alias("debt_min_per_day"),
        (F.stddev_samp(r) / F.nullif(F.avg(r), F.lit(0.0)) * 100).alias("rem_cv"), F.max_by(hours, day).alias("latest_hours"),
    )
    return g.withColumn("rebound_pct", F.when(F.col("low_nights") > 0, F.col("rebounds") / F.col("low_nights") * 100).otherwise(0.0)).withColumn("adequacy_pct", F.col("_a") * 100).drop("_a")


def benchmark_norms(means: DataFrame, norms: DataFrame, cohort: str) -> DataFrame:
    """Norm z and in-range flag of each metric mean against one cohort's range."""
    n = norms.where(F.col("cohort") == cohort)
    d = means.join(n, "metric").withColumn("norm_z", S.norm_range_z("mean", F.col("low"), F.col("high")))
    return d.withColumn("in_range", F.col("mean").between(F.col("low"), F.col("high")))
