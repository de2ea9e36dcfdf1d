"""Clock arithmetic on HH:mm:ss text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of(c: Column) -> Column:
    """Second of the day of HH:mm:ss text, NULL for text of another shape."""
    hours, minutes, seconds = (F.substring(c, at, 2).try_cast("int") for at in (1, 4, 7))
    return hours * 3600 + minutes * 60 + seconds


def clock(seconds: Column) -> Column:
    """HH:mm:ss text of a second of the day."""
    part = lambda v: F.lpad(v.cast("int").cast("string"), 2, "0")
    return F.concat_ws(":", part(F.floor(seconds / 3600)), part(F.floor(seconds / 60) % 60), part(seconds % 60))


def week_day(day: Column) -> Column:
    return F.lower(F.date_format(day, "EEEE"))


def slot_times(common_start: Column, common_end: Column, n: Column) -> tuple[Column, Column]:
    """Start and end second of the n-th one-hour slot; the end keeps the minutes of ``common_end``."""
    start = seconds_of(common_start) + n * 3600
    end = (F.floor(start / 3600) + 1) * 3600 + seconds_of(common_end) % 3600
    return start, end
