"""Row-by-row comparison of a Spark result with a SQL result, without regard to order."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLE_NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLE_NAMES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, dt.date):
        return f"{value.isoformat()} 00:00:00"
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    expected = rows_of(columns, result.fetchall())
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if actual == expected:
        return None
    return (
        f"{sum(actual.values())} rows, expected {sum(expected.values())}; types {types}; "
        f"only in Spark {list((actual - expected).items())[:3]}; "
        f"only in SQL {list((expected - actual).items())[:3]}"
    )
