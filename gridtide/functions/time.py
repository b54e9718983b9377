"""Wall clocks, instants and the hours where they disagree. The session time zone has to be UTC.

A wall-clock time is a timestamp without zone. In a spring gap no instant shows it; in an autumn fold two do. Both
are found by going to UTC and back, for any zone and year.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_clock(c: Column) -> Column:
    """A timestamp without zone as a timestamp that shows the same digits in UTC."""
    return c.cast("timestamp")


def wall_time(x: datetime) -> Column:
    """A wall-clock constant, as wall_clock gives columns."""
    return F.lit(x.isoformat(sep=" ")).cast("timestamp")


def naive(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def to_utc(wall: Column, tz: str) -> Column:
    return F.to_utc_timestamp(wall, tz)


def to_local(instant: Column, tz: str) -> Column:
    return F.from_utc_timestamp(instant, tz)


def is_gap(wall: Column, tz: str) -> Column:
    return to_local(to_utc(wall, tz), tz) != wall


def is_fold(wall: Column, tz: str) -> Column:
    hour = F.expr("INTERVAL 1 HOUR")
    utc = to_utc(wall, tz)
    return (to_local(utc + hour, tz) == wall) | (to_local(utc - hour, tz) == wall)


def hour_of(instant: Column) -> Column:
    return F.date_trunc("hour", instant)


def epoch(c: Column) -> Column:
    return c.cast("long")


def shift_hours(c: Column, hours: Column | int) -> Column:
    hours = hours if isinstance(hours, Column) else F.lit(hours)
    return c + F.make_interval(hours=hours)


def floor_cycle(c: Column, cycle_hours: int) -> Column:
    """The last start of a cycle (counted from midnight UTC) at or before an instant."""
    step = cycle_hours * 3600
    return F.timestamp_seconds(F.floor(epoch(c) / F.lit(step)) * F.lit(step))
