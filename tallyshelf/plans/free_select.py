"""Any single SELECT over the three tables, on Spark SQL."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from tallyshelf.session import tune


def register(tables: dict[str, DataFrame]) -> SparkSession:
    """The tables as temporary views of the session they belong to."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return next(iter(tables.values())).sparkSession


def isolated_session(spark: SparkSession) -> SparkSession:
    """A session of its own for views: same application and cluster, no clash of view names."""
    return tune(spark.newSession())


def free_select(spark: SparkSession, sql: str) -> DataFrame:
    """The result of one query over the registered tables; errors are raised, never replaced.

    Only what can stand as a subquery is run: commands and inserts, also after WITH, are refused before anything runs.
    """
    statement = sql.strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|with)\b", statement):
        raise ValueError("only a SELECT or a WITH query is accepted")
    try:
        spark.sql(f"SELECT * FROM (\n{statement}\n)")
    except ParseException as error:
        raise ValueError("only one query that reads is accepted") from error
    return spark.sql(statement)
