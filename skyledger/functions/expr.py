"""Scalar expressions. Everything here is a built-in Spark expression, so it
stays inside whole-stage code generation; there are no Python UDFs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower edges of the delay tiers (minutes) and their labels.
DELAY_EDGES = [0.0, 15.0, 60.0, 120.0, 240.0, 720.0]
TIER_LABELS = [
    "Early / On Time",
    "Minor (0-15)",
    "Moderate (15-60)",
    "Heavy (60-120)",
    "Severe (120-240)",
    "Extreme (240-720)",
    "Ultra (720+)",
]
# Labels of the exclusive forecast bands.
HORIZON_LABELS = {0: "<1h", 1: "1-3h", 3: "3-6h", 6: ">6h"}
SEVERE_MINUTES = 120.0
EARTH_RADIUS_KM = 6371.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- numbers


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Clamp, keeping null as null (greatest/least alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def round_even(c: Column | str, digits: int) -> Column:
    return F.bround(col(c), digits)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def share(condition: Column) -> Column:
    """Mean of a condition over the rows where it is known."""
    return F.avg(condition.cast("double"))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation over rows where both are known; null when one is constant."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(
        F.covar_samp(x, y),
        F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y)),
    )


def signed_log1p(c: Column | str) -> Column:
    return F.signum(col(c)) * F.log1p(F.abs(col(c)))


def signed_expm1(c: Column | str) -> Column:
    return F.signum(col(c)) * F.expm1(F.abs(col(c)))


def cyclic(c: Column | str, period: int) -> tuple[Column, Column]:
    angle = col(c) * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def step_index(c: Column | str, edges: Sequence[float]) -> Column:
    """How many of the ascending `edges` are <= c, by binary search in CASE form."""
    c = col(c)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c >= F.lit(float(edges[mid])), search(mid + 1, hi)).otherwise(search(lo, mid))

    return F.when(c.isNotNull(), search(0, len(edges)))


# ---------------------------------------------------------------- geography and weather


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def relative_humidity(temp: Column | str, dew: Column | str) -> Column:
    """Magnus approximation in percent, one digit."""
    t, d = col(temp), col(dew)
    magnus = lambda v: F.lit(17.625) * v / (F.lit(243.04) + v)
    return F.bround(F.lit(100.0) * F.exp(magnus(d) - magnus(t)), 1)


def wind_text_ms(c: Column | str) -> Column:
    """'15 mph' to metres per second; text without a number gives 0."""
    first = F.try_element_at(F.split(F.trim(col(c)), r"\s+"), F.lit(1))
    return F.coalesce(first.try_cast("double") * F.lit(0.44704), F.lit(0.0))


def delay_text_minutes(c: Column | str) -> Column:
    """'1 hour 30 minutes' or '45' to whole minutes; anything else gives 0."""
    text = F.lower(F.coalesce(col(c).cast("string"), F.lit("")))
    hours = F.regexp_extract(text, r"(?:^|\s)(\d+)\s+\S*hour", 1).try_cast("int")
    mins = F.regexp_extract(text, r"(?:^|\s)(\d+)\s+\S*min", 1).try_cast("int")
    worded = F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(mins, F.lit(0))
    bare = F.when(text.rlike(r"^[\d.]*\d[\d.]*$"), F.floor(text.try_cast("double")))
    return F.when(worded > 0, worded).otherwise(F.coalesce(bare.cast("int"), F.lit(0)))


def icao_to_iata(c: Column | str) -> Column:
    """Drop the leading K of a four-letter US code and upper-case; PANC is ANC."""
    code = F.upper(F.trim(col(c)))
    return F.when(code == "PANC", F.lit("ANC")).otherwise(F.regexp_replace(code, "^K(?=.{3}$)", ""))


def iata_to_icao(c: Column | str) -> Column:
    code = F.upper(F.trim(col(c)))
    return F.when(code == "ANC", F.lit("PANC")).otherwise(F.concat(F.lit("K"), code))


# ---------------------------------------------------------------- time


def floor_hour(c: Column | str) -> Column:
    """Start of the hour as timestamp_ntz, independent of the session time zone."""
    c = col(c)
    return c.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(c))


def ceil_hour(c: Column | str) -> Column:
    c = col(c)
    base = floor_hour(c)
    return F.when(c > base, base + F.expr("INTERVAL 1 HOUR")).otherwise(base)


def floor_minute(c: Column | str) -> Column:
    c = col(c)
    return c.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(c), F.minute(c))


def add_minutes(ts: Column | str, minutes: Column | int) -> Column:
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    return col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))


def add_hours(ts: Column | str, hours: Column | int) -> Column:
    h = F.lit(hours) if isinstance(hours, int) else hours
    return col(ts) + F.make_dt_interval(F.lit(0), h.cast("int"))


def _second_of_day(c: Column) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from start to end, independent of the session time zone."""
    a, b = col(start), col(end)
    days = F.date_diff(b.cast("date"), a.cast("date"))
    return days.cast("long") * 86400 + (_second_of_day(b) - _second_of_day(a))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return seconds_between(start, end) / F.lit(60.0)


def hours_between(start: Column | str, end: Column | str) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def hour_number(origin: Column | str, hour: Column | str) -> Column:
    """Running number of an hour start, 0 at `origin` (also an hour start)."""
    a, b = col(origin), col(hour)
    return (F.date_diff(b.cast("date"), a.cast("date")) * 24 + F.hour(b) - F.hour(a)).cast("int")


def clock(c: Column | str) -> Column:
    return F.date_format(col(c), "HH:mm")


def hhmm_minutes(c: Column | str, policy: str = "clamp") -> Column:
    """Minutes after midnight of an HHMM number.

    clamp: 2400 is 0:00 and null is 0:00; clip: 2400 is 23:00 and null is 0:00;
    both cap hour at 23 and minute at 59. strict: an invalid value is null.
    """
    t = F.floor(col(c).try_cast("double")).cast("int")
    if policy == "strict":
        h, m = F.floor(t / 100), F.pmod(t, F.lit(100))
        return F.when((t >= 0) & (h < 24) & (m < 60), h * 60 + m).cast("int")
    if policy not in ("clamp", "clip"):
        raise ValueError(f"unknown HHMM policy {policy!r}")
    t = F.coalesce(t, F.lit(0))
    if policy == "clamp":
        t = F.when(t == 2400, F.lit(0)).otherwise(t)
    h, m = clip(F.floor(t / 100), 0, 23), clip(F.pmod(t, F.lit(100)), 0, 59)
    return (h * 60 + m).cast("int")


# ---------------------------------------------------------------- labels


def tier_order(delay: Column | str) -> Column:
    """0..6 over half-open tiers; a missing delay has no tier."""
    return step_index(delay, DELAY_EDGES)


def tier_label(order: Column | str) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in TIER_LABELS]), col(order).cast("int") + 1)


def horizon_label(h: Column | str) -> Column:
    pairs = [F.lit(x) for kv in HORIZON_LABELS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(h))


def horizon_band(hours: Column | str) -> Column:
    """Start of the exclusive band [0,1) [1,3) [3,6) [6,..); null before 0."""
    h = col(hours)
    return F.when(h >= 6, 6).when(h >= 3, 3).when(h >= 1, 1).when(h >= 0, 0)


# Status, cause and alert labels of the next four functions.
def predicted_status(pred: Column | str) -> Column:
    p = col(pred)
    return (
        F.when(p < 5, "On Time").when(p < 20, "Minor").when(p < 45, "Moderate").when(p >= 45, "Severe")
    )


def actual_status(delay: Column | str) -> Column:
    d = col(delay)
    return (
        F.when(d >= 60, "Severe").when(d >= 30, "Moderate").when(d >= 15, "Minor")
        .when(d >= 0, "On Time").when(d < 0, "Early")
    )


def delay_cause(at_congested_airport: Column, inbound_late: Column) -> Column:
    return (
        F.when(at_congested_airport & inbound_late, "Congestion + Inbound delay")
        .when(at_congested_airport, "Airport congestion")
        .when(inbound_late, "Inbound aircraft delay")
        .otherwise("Schedule/Weather pattern")
    )


def alert_result(alert: Column, severe: Column) -> Column:
    alert, severe = F.coalesce(alert, F.lit(False)), F.coalesce(severe, F.lit(False))
    return F.when(alert & severe, "TP").when(alert, "FP").when(severe, "FN").otherwise("TN")


def alert_order(result: Column | str) -> Column:
    r = col(result)
    return F.when(r == "TP", 0).when(r == "FP", 1).when(r == "FN", 2).when(r == "TN", 3).otherwise(99)


def rotation_risk(arr_delay: Column | str, turnaround: Column | str) -> Column:
    """Shifted sigmoid of inbound delay over turnaround; a missing delay counts as 0."""
    load = F.greatest(F.coalesce(col(arr_delay), F.lit(0.0)), F.lit(0.0)) / F.greatest(
        col(turnaround), F.lit(1.0)
    )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.0) - load))


def us_tail(c: Column | str) -> Column:
    return col(c).rlike(r"^N\d")


def route(origin: Column | str, dest: Column | str, sep: str = " -> ") -> Column:
    return F.concat(col(origin), F.lit(sep), col(dest))


def natural_key(origin: Column | str, dest: Column | str, dep: Column | str) -> Column:
    return F.struct(
        col(origin).alias("ORIGIN"), col(dest).alias("DEST"), F.hour(col(dep)).alias("dep_hour")
    )


def matches_text(needle: str, *columns: Column | str) -> Column:
    """Case-insensitive substring search over the columns joined by blanks."""
    hay = F.lower(F.concat_ws(" ", *[col(c).cast("string") for c in columns]))
    return hay.contains(needle.lower())


# ---------------------------------------------------------------- ordinal probabilities


def threshold_column(threshold: float) -> str:
    return f"p_ge_{int(threshold)}"


def bucket_column(lo: float | None = None, hi: float | None = None) -> str:
    if lo is None:
        return f"p_bucket_lt_{int(hi)}"
    return f"p_bucket_ge_{int(lo)}" if hi is None else f"p_bucket_{int(lo)}_{int(hi)}"


def monotone_probs(columns: Sequence[Column | str]) -> list[Column]:
    """Clip to [0, 1] and force non-increasing order by a running minimum; after a null all are null."""
    clipped = [clip(c, 0.0, 1.0) for c in columns]
    known = [F.lit(True)]
    for c in clipped:
        known.append(known[-1] & c.isNotNull())
    return [clipped[0]] + [F.when(known[i + 1], F.least(*clipped[: i + 1])) for i in range(1, len(clipped))]


def bucket_masses(columns: Sequence[Column | str], edges: Sequence[float] = DELAY_EDGES) -> dict[str, Column]:
    """Probability mass of each of the len(edges)+1 delay buckets."""
    mono = monotone_probs(columns)
    out = {bucket_column(None, edges[0]): F.lit(1.0) - mono[0]}
    for i in range(len(edges) - 1):
        out[bucket_column(edges[i], edges[i + 1])] = mono[i] - mono[i + 1]
    out[bucket_column(edges[-1], None)] = mono[-1]
    return out


# ---------------------------------------------------------------- horizon masking

MASK_FULL = 2.0 / 24
MASK_PARTIAL = 1.0 / 24


def mask_by_horizon(c: Column | str, h2dep_norm: Column | str, *, partial: bool) -> Column:
    """Zero a gate feature more than 2 h ahead; `partial` ones also from 1 h to 2 h."""
    limit = MASK_PARTIAL if partial else MASK_FULL
    return F.when(col(h2dep_norm) > F.lit(limit), F.lit(0.0)).otherwise(col(c))
