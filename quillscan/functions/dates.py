"""Date functions on times without zone; the clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(at: Column) -> Column:
    """Milliseconds since 1970, the time taken as UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def iso(at: Column) -> Column:
    """The ISO text of a time, with milliseconds and a Z."""
    return F.date_format(at.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def days_before(clock: Column, days: int) -> Column:
    return F.date_sub(clock.cast("date"), days)
