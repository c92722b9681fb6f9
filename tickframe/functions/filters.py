"""Time predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minute_of_day(ts: Column) -> Column:
    """Minutes since midnight with their fraction."""
    return F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60.0


def within_day(ts: Column, start: float, end: float) -> Column:
    """Inclusive at both ends; a start past the end wraps round midnight."""
    m = minute_of_day(ts)
    return (m >= start) & (m <= end) if start <= end else (m >= start) | (m <= end)


def paused(ts: Column, start: int | None, end: int | None) -> Column:
    """Half-open [start, end) in whole minutes, wrapping; equal or missing bounds, or ones outside a day, never pause."""
    if start is None or end is None or start == end or not (0 <= start < 1440 and 0 <= end < 1440):
        return F.lit(False)
    m = F.hour(ts) * 60 + F.minute(ts)
    return (m >= start) & (m < end) if start < end else (m >= start) | (m < end)
