"""Time expressions. Naive timestamps are read in one fixed zone; 'now' is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the zone naive operational timestamps are written in.
ZONE = "Australia/Sydney"
DAY_MICROS = 86_400_000_000


def localise(naive: Column, zone: str = ZONE) -> Column:
    """The UTC instant of a naive local time."""
    return F.to_utc_timestamp(naive.cast("timestamp"), zone)


def days_between(start: Column, end: Column) -> Column:
    """Signed fractional days from start to end."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(float(DAY_MICROS))


def minutes_as_of(started: Column, ended: Column, at: Column) -> Column:
    """Minutes of one time log known at an instant: running or later ends are cut there."""
    end = F.least(F.coalesce(ended, at), at)
    minutes = (F.unix_micros(end) - F.unix_micros(started)) / F.lit(60e6)
    return F.when(started <= at, F.greatest(minutes, F.lit(0.0)))
