"""Expressions that several models share; all are built from JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the traffic model: weight of each local hour, campaign days, their factor, the zone.
HOUR_WEIGHTS = (0.15, 0.08, 0.05, 0.04, 0.05, 0.10, 0.30, 0.55, 0.75, 0.85, 0.95, 1.00, 1.05, 0.95, 0.90, 0.95, 1.00, 1.10, 1.25, 1.45, 1.55, 1.40, 1.00, 0.55)
CAMPAIGN_DAYS = ("09-09", "11-11", "12-12")
CAMPAIGN_FACTOR = 5.0
LOCAL_ZONE = "Asia/Jakarta"


def surrogate_key(*parts: Column) -> Column:
    """A stable 60-bit key: the first 15 hex digits of the md5 of the parts, joined by a bar."""
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def half_up_ratio(part: Column, whole: Column, digits: int) -> Column:
    """part / whole rounded half up, in whole numbers so that every engine agrees; NULL for whole 0."""
    scaled, n = part.cast("decimal(38,0)") * (2 * 10**digits), F.nullif(whole.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    sign = F.when(scaled < 0, -1).otherwise(1)
    return (sign * F.floor((F.abs(scaled) + n) / (n * 2)).cast("double")) / float(10**digits)


def cents(amount: Column) -> Column:
    """A decimal amount in hundredths."""
    return (amount * 100).cast("decimal(38,0)")


def month_number(first: Column, day: Column) -> Column:
    """Calendar months from one date to another."""
    return ((F.year(day) - F.year(first)) * 12 + F.month(day) - F.month(first)).cast("int")


def status_for(value: Column, warn_at: Column, error_at: Column, higher_is_worse: bool = True) -> Column:
    """ok, warn or error; a value at a threshold has reached it."""
    reached = (lambda limit: value >= limit) if higher_is_worse else (lambda limit: value <= limit)
    return F.when(reached(error_at), "error").when(reached(warn_at), "warn").otherwise("ok")


def traffic_multiplier(ts: Column) -> Column:
    """Expected traffic at a UTC instant, as a multiple of the daily mean."""
    local = F.from_utc_timestamp(ts, LOCAL_ZONE)
    weight = F.element_at(F.array(*map(F.lit, HOUR_WEIGHTS)), F.hour(local) + 1)
    return weight * F.when(F.date_format(local, "MM-dd").isin(*CAMPAIGN_DAYS), CAMPAIGN_FACTOR).otherwise(1.0)
