"""Cubes with distinct users: exactly, and from sketches that are kept per cell and merged again.

A cell is one combination of dimension values, a cube has a row for every cell of every subset of the dimensions. ``level`` is Spark's
grouping id, a bit per dimension that is summed over, so that a total is never taken for a null value.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The binary logarithm of a sketch's registers: 2^14 of them take 8 to 16 kB and err by about 0.8 % (one deviation).
LG_REGISTERS = 14


def exact_cube(rows: DataFrame, dimensions: list[str], user: str = "user_id") -> DataFrame:
    """``*dimensions, level, row_count, users`` with exact numbers of distinct users; null users count as rows only.

    A user's rows in one cell become one row before the cube multiplies anything. Distinct users are then counted by cell and user first, so
    the total over everything is spread over all tasks as well.
    """
    merged = rows.groupBy(*dimensions, user).agg(F.count("*").alias("rows"))
    subsets = [kept for n in range(len(dimensions) + 1) for kept in combinations(dimensions, n)]
    # The user is part of every set, as the last and so the lowest bit of the grouping id.
    by_user = merged.groupingSets([[*kept, user] for kept in subsets], *dimensions, user).agg(
        F.shiftright(F.grouping_id(), 1).alias("level"), F.sum("rows").alias("rows"))
    return by_user.groupBy(*dimensions, "level").agg(F.sum("rows").alias("row_count"), F.count(user).alias("users"))


def user_cells(rows: DataFrame, dimensions: list[str], user: str = "user_id", lg_registers: int = LG_REGISTERS) -> DataFrame:
    """``*dimensions, row_count, state``: per finest cell its rows and a sketch of its users, to be written and merged later.

    Sketches are built map-side: one state per cell and task is shuffled, whatever the number of users.
    """
    return rows.groupBy(*dimensions).agg(
        F.count("*").alias("row_count"), F.hll_sketch_agg(user, F.lit(lg_registers)).alias("state"))


def merge_cells(cells: DataFrame, dimensions: list[str]) -> DataFrame:
    """Cells of fewer or coarser dimensions, or of several stored tables, as cells again."""
    return cells.groupBy(*dimensions).agg(F.sum("row_count").alias("row_count"), F.hll_union_agg("state").alias("state"))


def cube_of_cells(cells: DataFrame, dimensions: list[str]) -> DataFrame:
    """The cube of stored cells: ``*dimensions, level, row_count, users``; ``users`` is an estimate, ``row_count`` is exact."""
    finest = merge_cells(cells, dimensions)
    cube = finest.cube(*dimensions).agg(
        F.grouping_id().alias("level"), F.sum("row_count").alias("row_count"), F.hll_union_agg("state").alias("state"))
    return cube.select(*dimensions, "level", "row_count", F.hll_sketch_estimate("state").alias("users"))
