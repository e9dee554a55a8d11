"""Calendar buckets in whole microseconds, with a fixed offset from UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrank.errors import require

#: The units, and the largest offset in minutes.
UNITS, MOST_OFFSET = ("minute", "hour", "day", "week", "month", "quarter", "year"), 1080


def bucket_start(micros: Column, unit: str, offset_minutes: int = 0) -> Column:
    """Start of the calendar unit that holds an instant, in microseconds; weeks begin on Monday."""
    require(unit in UNITS, f"the unit {unit}")
    require(abs(offset_minutes) <= MOST_OFFSET, f"an offset of {offset_minutes} minutes")
    shift = offset_minutes * 60_000_000
    return F.unix_micros(F.date_trunc(unit, F.timestamp_micros(micros + shift))) - shift
