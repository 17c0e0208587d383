"""Naive wall clocks, instants and local dates as column expressions.

A naive wall clock is ``timestamp_ntz``; an instant is ``timestamp``. The session zone is UTC, so a
cast between the two is the identity on the UTC wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def naive_local_to_utc(c: Column, tz: str, overlap: str = "1 hour") -> Column:
    """Naive wall clock in ``tz`` -> naive UTC; an ambiguous wall clock is its second occurrence.

    Spark resolves an ambiguous reading to the first occurrence. If the reading one ``overlap``
    later shows the same wall clock, that later instant is the second occurrence.
    """
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), c)
    later = utc + F.expr(f"interval {overlap}")
    return F.when(F.convert_timezone(F.lit("UTC"), F.lit(tz), later) == c, later).otherwise(utc)


def naive_local_to_instant(c: Column, tz: str, overlap: str = "1 hour") -> Column:
    return naive_local_to_utc(c, tz, overlap).cast("timestamp")


def window_instant(c: Column, tz: str) -> Column:
    """An instant inside the window whose local bounds hold the wall clock ``c``.

    It is the instant of ``c``, but for a reading that the clocks skipped: that lies before the change,
    as far from it as the reading is from the end of the gap.
    """
    utc = naive_local_to_utc(c, tz)
    skipped = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc) - c
    return (utc - skipped).cast("timestamp")


def naive_utc_to_instant(c: Column) -> Column:
    return c.cast("timestamp")


def instant_to_local(c: Column, tz: str) -> Column:
    """Instant (or naive UTC) -> naive wall clock in ``tz``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), c.cast("timestamp_ntz"))


def local_date(c: Column, tz: str) -> Column:
    return instant_to_local(c, tz).cast("date")


def naive_date(c: Column) -> Column:
    return c.cast("date")


def seconds_between(a: Column, b: Column) -> Column:
    """Second boundaries crossed from ``a`` to ``b`` (0.9 s to 1.1 s counts one)."""
    return F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))


def hours_between(a: Column, b: Column) -> Column:
    return seconds_between(a, b) / F.lit(3600.0)


def trunc_hour(c: Column) -> Column:
    return F.date_trunc("hour", c)
