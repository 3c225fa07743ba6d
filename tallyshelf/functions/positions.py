"""Seconds and buckets of zone-less timestamps, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def seconds(timestamp: Column) -> Column:
    """Whole seconds since 1970 on the timestamp's own clock."""
    days = F.unix_date(timestamp.cast("date")).cast("bigint")
    return days * DAY + F.hour(timestamp) * 3600 + F.minute(timestamp) * 60 + F.second(timestamp)


def bucket(timestamp: Column, width: Column | int) -> Column:
    """The number of the bucket of ``width`` seconds that holds the timestamp."""
    return F.floor(seconds(timestamp) / width).cast("bigint")
