"""Epoch numbers whose unit (s, ms, us, ns) is told by their magnitude."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An epoch below the bound has the unit beside it.
SECONDS_BELOW = 100_000_000_000  # 1e11
MILLIS_BELOW = 100_000_000_000_000  # 1e14
MICROS_BELOW = 100_000_000_000_000_000  # 1e17

DAY_MS = 86_400_000


def floor_div(value: Column, by: int) -> Column:
    """Exact floor division of longs, also below zero (``floor(a/b)`` goes through doubles)."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def _within(value: Column, bound: int) -> Column:
    return (value < bound) & (value > -bound)


def epoch_us(value: Column) -> Column:
    """Microseconds of an epoch in s, ms, us or ns; null stays null.

    Nanoseconds are floored to the microsecond.
    """
    v = value.cast("long")
    return (
        F.when(_within(v, SECONDS_BELOW), v * 1_000_000)
        .when(_within(v, MILLIS_BELOW), v * 1_000)
        .when(_within(v, MICROS_BELOW), v)
        .otherwise(floor_div(v, 1_000))
    )


def epoch_ms(value: Column) -> Column:
    """Milliseconds of an epoch in s, ms, us or ns, finer parts floored."""
    v = value.cast("long")
    return (
        F.when(_within(v, SECONDS_BELOW), v * 1_000)
        .when(_within(v, MILLIS_BELOW), v)
        .when(_within(v, MICROS_BELOW), floor_div(v, 1_000))
        .otherwise(floor_div(v, 1_000_000))
    )


def is_millis(value: Column) -> Column:
    v = value.cast("long")
    return _within(v, MILLIS_BELOW) & ~_within(v, SECONDS_BELOW)


def period_ms(frequency: Column) -> Column:
    """Length of a period written ``<n>m``, ``<n>h`` or ``<n>d``; null for anything else."""
    n = F.try_to_number(F.regexp_extract(frequency, r"^(\d{1,4})[mhd]$", 1), F.lit("9999")).cast("long")
    unit = F.substring(frequency, -1, 1)
    return F.when(n > 0, n * F.when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", DAY_MS))


def utc_day(ms: Column) -> Column:
    """UTC calendar day of an instant in ms, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ms, DAY_MS).cast("int"))
