"""Sort keys with nulls last in both directions, and tie-breaks that make a top-k definite."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LARGEST_LIMIT = 2**31 - 1  # Spark counts a limit in a 32-bit integer
_COPIES_PER_ROW = 100_000
BROADCAST_ROWS = 100_000  # a top-k of at most this many rows may be sent to every executor


def asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def desc(name: str) -> Column:
    return F.col(name).desc_nulls_last()


def then_by_rest(df: DataFrame, used: Iterable[str]) -> list[Column]:
    """All columns not in ``used``, ascending: rows that still tie are equal in every column."""
    taken = set(used)
    return [asc(name) for name in df.columns if name not in taken]


def take(df: DataFrame, keys: list[Column], n: int | None) -> DataFrame:
    """Sort, and keep the first ``n`` when given (planned as one TakeOrderedAndProject).

    A limit that Spark cannot count raises ``ValueError``; it is never left out.
    """
    if n is not None and n > _LARGEST_LIMIT:
        raise ValueError(f"a limit is at most {_LARGEST_LIMIT}, not {n}")
    ordered = df.orderBy(*keys)
    return ordered if n is None else ordered.limit(n)


def sort_copies(df: DataFrame, keys: list[Column]) -> DataFrame:
    """A global sort that stays balanced when very many rows are equal in every column.

    Equal rows cannot be told apart by any sort key, so a range exchange would send all of them to
    one task. They are counted first (map-side), sorted as runs of at most 100,000 that carry a
    run number, and written out again after the sort.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    last_run = F.expr(f"(copies - 1) DIV {_COPIES_PER_ROW}")
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), last_run)))
    left = F.col("copies") - F.col("run") * _COPIES_PER_ROW
    size = F.least(F.lit(_COPIES_PER_ROW), left).cast("int")
    return (
        runs.withColumn("size", size)
        .orderBy(*keys, "run")
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("size"))))
        .select(*df.columns)
    )
