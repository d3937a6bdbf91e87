"""Elapsed-time arithmetic on epoch microseconds.

A day is 24 elapsed hours and partial days round down, also below zero, so none of this
is calendar-day arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def instant(value: Column | str) -> Column:
    """A timestamp literal from text, or the column itself."""
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def elapsed_days(later: Column, earlier: Column) -> Column:
    return F.floor((micros(later) - micros(earlier)) / F.lit(float(DAY_US))).cast("double")


def elapsed_hours(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(HOUR_US))


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def month_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
