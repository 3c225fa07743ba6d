"""Small declared tables from dictionaries; columns not given are null."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tallyshelf.schemas import TABLES


def table(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    spec = TABLES[name]
    return spark.createDataFrame([tuple(r.get(c) for c in spec.columns) for r in rows], spec.schema)


def day(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def dicts(df: DataFrame) -> list[dict]:
    return [row.asDict() for row in df.collect()]
