"""Lease times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(count: Column) -> Column:
    """A day-time interval of ``count`` seconds."""
    nothing = F.lit(0)
    return F.make_dt_interval(nothing, nothing, nothing, count.cast("decimal(18,6)"))


def expires_at(start: Column, ttl_seconds: Column) -> Column:
    """End of a lease that starts (or is refreshed) at ``start``."""
    return start + seconds(ttl_seconds)


def beat_seconds(ttl_seconds: Column) -> Column:
    """Interval between heartbeats: 0.4 of the ttl, never under 10 s."""
    return F.greatest(F.lit(10.0), ttl_seconds * F.lit(0.4))
