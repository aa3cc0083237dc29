"""Row-level expressions.  Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded value without a negative zero, for results that are compared."""
    return F.round(col(c), digits) + F.lit(0.0)


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL, the only missing marker at the edges."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


# --- arithmetic guards -------------------------------------------------------

def share_pct(part: Column | str, *totals: Column | str) -> Column:
    """``part`` as percent of the sum of ``totals``; NULL when that sum is 0."""
    whole = col(totals[0])
    for t in totals[1:]:
        whole = whole + col(t)
    return col(part) / F.nullif(whole, F.lit(0)) * 100


def safe_ratio(n: Column | str, d: Column | str, fill: float | None = 0.0, eps: float = 0.0) -> Column:
    """n/d with ``fill`` where the denominator is missing, 0 or within ``eps`` of it."""
    n, d = col(n), col(d)
    ok = d.isNotNull() & (F.abs(d) > F.lit(eps))
    return F.when(ok & n.isNotNull(), n / d).otherwise(F.lit(fill).cast("double"))


def convert(value: Column | str, rule: Column | str) -> Column:
    """Unit rule named per row: sec_to_hours, sec_to_min, abs, or nothing."""
    v, rule = col(value), col(rule)
    return (
        F.when(rule == "sec_to_hours", v / 3600)
        .when(rule == "sec_to_min", v / 60)
        .when(rule == "abs", F.abs(v))
        .otherwise(v)
    )


def strain_ratio(strain: Column | str, relief: Column | str, cap: float = 5.0) -> Column:
    """strain/relief; without relief it is ``cap`` under strain and 1 at rest."""
    s, r = col(strain), col(relief)
    return (
        F.when(s.isNull() | r.isNull(), F.lit(None).cast("double"))
        .when(r > 0, s / r)
        .when(s > 0, F.lit(cap))
        .otherwise(F.lit(1.0))
    )


def dip_pct(awake: Column | str, asleep: Column | str) -> Column:
    a, s = col(awake), col(asleep)
    return F.when((a > 0) & s.isNotNull(), (a - s) / a * 100)


def clip(x: Column | str, low: float, high: float) -> Column:
    """NULL stays NULL (``least``/``greatest`` alone would swallow it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, num(low)), num(high)))


def linear_score(x: Column | str, zero_at: float, full_span: float) -> Column:
    """0 at ``zero_at``, 100 at ``zero_at + full_span``, clipped to 0-100."""
    return clip((col(x) - num(zero_at)) / num(full_span) * 100, 0, 100)


def target_scale(v: Column | str, target: float) -> Column:
    return clip(col(v) / num(target) * 100, 0, 120)


def norm_range_z(x: Column | str, low: Column | float, high: Column | float) -> Column:
    low, high = num(low), num(high)
    return (col(x) - (low + high) / 2) / F.nullif((high - low) / 2, F.lit(0.0))


def piecewise(x: Column | str, knots: Sequence[tuple[float, float]]) -> Column:
    """Linear between (x, y) knots, flat outside them."""
    x = col(x)
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) / (x1 - x0) * (y1 - y0))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(knots[-1][1]))))


# --- normal distribution -----------------------------------------------------

# Chebyshev coefficients of the complementary error function
# (relative error below 1.2e-7 everywhere), constant term first.
ERFC_COEF = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def erfc(x: Column | str) -> Column:
    x = col(x).cast("double")
    a = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + a * 0.5)
    poly = F.lit(ERFC_COEF[-1])
    for c in reversed(ERFC_COEF[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(poly - a * a)
    return F.when(x >= 0, tail).otherwise(F.lit(2.0) - tail)


def norm_cdf(z: Column | str) -> Column:
    return erfc(-col(z) / F.lit(2.0 ** 0.5)) * 0.5


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it.

    Without it a filter on the result is pushed below the projections and copies
    the whole expression tree of ``value`` into every use.
    """
    return F.element_at(F.transform(F.array(value), lambda v: fn(v)), 1)


def norm_p2(z: Column | str) -> Column:
    """Two-sided normal p-value, for one row per test."""

    def tail(a: Column) -> Column:
        t = F.lit(1.0) / (F.lit(1.0) + a * 0.5)
        poly = F.lit(ERFC_COEF[-1])
        for c in reversed(ERFC_COEF[:-1]):
            poly = F.lit(c) + t * poly
        return F.least(t * F.exp(poly - a * a), F.lit(1.0))

    a = F.abs(col(z).cast("double")) / F.lit(2.0 ** 0.5)
    return bind(a, lambda v: F.when(v.isNotNull(), tail(v)))


def norm_score(x: Column | str, mean: float, sd: float) -> Column:
    return norm_cdf((col(x) - num(mean)) / num(sd)) * 100


def erfc_sql(x: str) -> str:
    """The same polynomial as SQL text, for twins of p-values."""
    a = f"abs({x})"
    t = f"(1.0e0/(1.0e0+{a}*0.5e0))"
    poly = f"{ERFC_COEF[-1]}e0"
    for c in reversed(ERFC_COEF[:-1]):
        poly = f"({c}e0+{t}*{poly})"
    tail = f"({t}*exp({poly}-{a}*{a}))"
    return f"(CASE WHEN {x} >= 0 THEN {tail} ELSE 2.0e0-{tail} END)"


def norm_p2_sql(z: str) -> str:
    return f"least({erfc_sql(f'(abs({z})/{2.0 ** 0.5!r}e0)')}, 1.0e0)"


# --- labels ------------------------------------------------------------------

def bands(x: Column | str, edges: Sequence[tuple[float, str]], top: str, closed: str = "left") -> Column:
    """Label of the first band whose upper edge lies above ``x``.

    ``closed="left"`` means ``x < edge`` picks the band, ``"right"`` means ``x <= edge``.
    """
    x = col(x)
    out = None
    for edge, label in edges:
        hit = (x < F.lit(edge)) if closed == "left" else (x <= F.lit(edge))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.when(x.isNotNull(), out.otherwise(top))


# Band edges of the named classifiers.
BANDS = {
    "cliffs_delta": ([(0.147, "negligible"), (0.33, "small"), (0.474, "medium")], "large"),
    "cohens_d": ([(0.2, "negligible"), (0.5, "small"), (0.8, "medium")], "large"),
    "breathing_index": ([(5.0, "NORMAL"), (15.0, "MILD ELEVATION"), (30.0, "MODERATE")], "SEVERE"),
    "stress_index": ([(150.0, "normal"), (500.0, "moderate_stress"), (1000.0, "high_stress")], "pathological"),
    "composite_risk": ([(20.0, "LOW"), (40.0, "MODERATE"), (60.0, "ELEVATED")], "HIGH"),
}
TEMPERATURE_BANDS = {"hypothermia": -1.0, "normal_low": -0.5, "mild": 0.5, "fever": 1.0}


def named_band(x: Column | str, name: str) -> Column:
    edges, top = BANDS[name]
    return bands(x, edges, top)


def temperature_band(delta: Column | str) -> Column:
    d, t = col(delta), TEMPERATURE_BANDS
    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(d > t["fever"], "fever")
        .when(d > t["mild"], "mild_elevation")
        .when(d >= t["normal_low"], "normal")
        .when(d >= t["hypothermia"], "mild_low")
        .otherwise("hypothermia")
    )


def change_direction(delta: Column | str, pct: Column | str, higher_is_better: Column | bool | None) -> Column:
    """improving / declining with a 3 % dead band; unknown polarity treats growth as decline."""
    delta, pct = col(delta), col(pct)
    better = higher_is_better if isinstance(higher_is_better, Column) else F.lit(higher_is_better).cast("boolean")
    good = F.when(F.coalesce(better, F.lit(False)), delta > 0).otherwise(delta <= 0)
    return F.when(F.abs(pct) < 3.0, "stable").when(good, "improving").otherwise("declining")


def outside_limits(x: Column, low: Column, high: Column) -> Column:
    return F.coalesce(x < low, F.lit(False)) | F.coalesce(x > high, F.lit(False))


def traffic_light(
    mean: Column | str, direction: Column | str, pct: Column | str,
    normal_low: Column, normal_high: Column, critical_low: Column, critical_high: Column,
) -> Column:
    mean, direction, size = col(mean), col(direction), F.abs(col(pct))
    falling, inside = direction == "declining", mean.between(normal_low, normal_high)
    return (
        F.when(outside_limits(mean, critical_low, critical_high) | (falling & (size > 10)), "critical")
        .when((falling & (size > 5)) | ~inside, "warning")
        .otherwise("good")
    )


def kpi_status(v: Column | str, warn: float, critical: float) -> Column:
    """warn < critical means higher is worse, otherwise lower is worse."""
    v = col(v)
    if warn < critical:
        bad, soso = v >= critical, v >= warn
    else:
        bad, soso = v <= critical, v <= warn
    return F.when(v.isNull(), "neutral").when(bad, "critical").when(soso, "warning").otherwise("good")


def level_label(raw: Column | str) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(col(raw).cast("string"))), F.lit("")), F.lit("N/A"))


def level_status(raw: Column | str) -> Column:
    level = level_label(raw)
    return (
        F.when(level == "HIGH", "critical")
        .when(level.isin("ELEVATED", "MODERATE"), "warning")
        .when(level == "LOW", "normal")
        .otherwise("neutral")
    )


def p_text(p: Column | str, digits: int = 3) -> Column:
    p = finite(p)
    return F.when(p.isNull(), "N/A").when(p < 0.001, "p<0.001").otherwise(
        F.concat(F.lit("p="), F.format_string(f"%.{digits}f", p))
    )


# Codes of sleep phases and movement classes.
PHASES = {1: "deep", 2: "light", 3: "REM", 4: "awake"}
MOVEMENTS = {1: "still", 2: "restless", 3: "toss/turn", 4: "active"}
DEPTH = {1: 3, 2: 2, 3: 1, 4: 0}


def code_label(code: Column | str, labels: dict) -> Column:
    out = None
    for key, label in labels.items():
        out = F.when(col(code) == key, label) if out is None else out.when(col(code) == key, label)
    return out


def depth_signal(phase: Column | str) -> Column:
    return code_label(phase, DEPTH).cast("double")


# --- clocks and calendars ----------------------------------------------------

def clock_hour(ts: Column | str) -> Column:
    ts = col(ts)
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def late_hour(ts: Column | str) -> Column:
    """Bedtime as hours from the evening's midnight: 01:30 reads 25.5."""
    h = clock_hour(ts)
    return F.when(h < 12, h + 24).otherwise(h)


def sleep_midpoint(start: Column | str, end: Column | str) -> Column:
    bed = late_hour(start)
    wake = clock_hour(end)
    wake = F.when(wake < bed, wake + 24).otherwise(wake)
    return (bed + wake) / 2


def is_weekend_night(day: Column | str) -> Column:
    """Nights towards Saturday and Sunday (Monday = 0)."""
    return F.weekday(col(day)).isin(4, 5)


def night_hour(ts: Column | str) -> Column:
    """0 at 22:00 … 9 at 07:00, NULL by day."""
    slot = F.pmod(F.hour(col(ts)) - F.lit(22), F.lit(24))
    return F.when(slot < 10, slot)


def days_since(day: Column | str, event: Column | date) -> Column:
    return F.datediff(col(day), event if isinstance(event, Column) else F.lit(event))


def phase_label(day: Column | str, first: date | Column, second: date | Column | None = None) -> Column:
    day = col(day)
    lit = lambda d: d if isinstance(d, Column) else F.lit(d)
    out = F.when(day < lit(first), "pre")
    if second is not None:
        out = out.when(day < lit(second), "mid")
    return out.otherwise("post")


def zone_clock(ts: Column | str, zone: str) -> Column:
    """Local wall clock of a UTC timestamp; hour, minute and day parts follow from it."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(ts).cast("timestamp_ntz"))


# --- text keys ---------------------------------------------------------------

OFFSET = r"([+-]\d{2}:?\d{2}|Z)$"


def lenient_ts(raw: Column | str) -> Column:
    """Any ISO-8601 text to an instant; unreadable text to NULL."""
    return F.try_to_timestamp(col(raw))


def naive_ts(raw: Column | str) -> Column:
    """Wall clock of the text: fraction and zone suffix cut off (both signs)."""
    clean = F.regexp_replace(F.regexp_replace(col(raw), OFFSET, ""), r"\.\d+$", "")
    return F.try_to_timestamp(F.replace(clean, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))


def day_key(raw: Column | str, mode: str = "utc", zone: str = "UTC") -> Column:
    """The three day keys of a stamped text: ``wall``, ``utc`` or ``zone``."""
    if mode == "wall":
        return F.substring(col(raw), 1, 10).try_cast("date")
    if mode == "utc":
        # the session clock may be any zone: shift the instant's clock to UTC explicitly
        return F.to_date(F.convert_timezone(None, F.lit("UTC"), F.to_timestamp_ntz(lenient_ts(raw).cast("string"))))
    if mode == "zone":
        return F.to_date(F.convert_timezone(None, F.lit(zone), F.to_timestamp_ntz(lenient_ts(raw).cast("string"))))
    raise ValueError(f"unknown day key {mode!r}")


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    origin = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("MICROSECOND", origin, col(ts).cast("timestamp_ntz"))


def hash_prefix(text: Column | str, length: int = 16) -> Column:
    return F.substring(F.sha2(col(text), 256), 1, length)


def pinned_milestone(months: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Straight line through two (month, value) norms, also beyond them."""
    (m0, v0), (m1, v1) = low, high
    return F.lit(v0) + (months - m0) / (m1 - m0) * (v1 - v0)


def months_between_event(as_of: date, event: date) -> float:
    return (as_of - event).days / 30.44
