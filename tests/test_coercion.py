"""Dates in the forms exports write, and zones by name."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyshelf.functions.coercion import to_timestamp_ntz

CASES = {
    "2024-01-05 10:00:00 Europe/Paris": dt.datetime(2024, 1, 5, 9),
    "2024-07-05 10:00:00 America/New_York": dt.datetime(2024, 7, 5, 14),
    "2024-01-05 10:00:00 Mars/Olympus": None,
    "2024-01-05T10:00:00+0530": dt.datetime(2024, 1, 5, 4, 30),
    "2024-01-05 10:00:00Z": dt.datetime(2024, 1, 5, 10),
    "2024-01-05 10:00:00.25": dt.datetime(2024, 1, 5, 10, 0, 0, 250_000),
    "2024-01-05": dt.datetime(2024, 1, 5),
    "01/05/2024": dt.datetime(2024, 1, 5),
    "1/5/2024 10:30": dt.datetime(2024, 1, 5, 10, 30),
    "1/5/2024 10:30:15": dt.datetime(2024, 1, 5, 10, 30, 15),
    "2024/01/05 10:00": dt.datetime(2024, 1, 5, 10),
    "2024/1/5": dt.datetime(2024, 1, 5),
    "Jan 5 2024": dt.datetime(2024, 1, 5),
    "Jan 5, 2024": dt.datetime(2024, 1, 5),
    "5 Jan 2024": dt.datetime(2024, 1, 5),
    "13/25/2024": None, "soon": None, "": None, "10:00:00": None, "2024-13-01": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates(spark, zone):
    rows = spark.createDataFrame([(t,) for t in CASES], "t string")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = {r.t: r.at for r in rows.select("t", to_timestamp_ntz(F.col("t")).alias("at")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == CASES


def test_given_formats_come_first(spark):
    rows = spark.createDataFrame([("01/05/2024",), ("25/12/2024",), ("12/25/2024",)], "t string")
    found = [r[0] for r in rows.select(to_timestamp_ntz(F.col("t"), ["dd/MM/yyyy"])).collect()]
    assert found == [dt.datetime(2024, 5, 1), dt.datetime(2024, 12, 25), dt.datetime(2024, 12, 25)]
