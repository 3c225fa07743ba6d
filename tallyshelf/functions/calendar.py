"""Month arithmetic on zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(timestamp: Column) -> Column:
    """First instant of the month as TIMESTAMP_NTZ, by way of DATE so no time zone is involved."""
    return F.trunc(timestamp.cast("date"), "month").cast("timestamp_ntz")


def month_number(timestamp: Column) -> Column:
    """Months since year zero, for differences between months."""
    return F.year(timestamp) * 12 + F.month(timestamp)
