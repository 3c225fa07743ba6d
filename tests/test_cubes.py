from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tallyshelf.operators import cubes


def _rows(spark):
    rows = [("a", 1, 1), ("a", 1, 1), ("a", 2, None), ("a", None, 2), (None, 1, 3), ("b", 2, 1)]
    return spark.createDataFrame(rows, "x string, y int, user_id int")


def _brute(rows, dimensions):
    cells = {}
    for n in range(len(dimensions) + 1):
        for kept in combinations(dimensions, n):
            level = sum(0 if d in kept else 1 << (len(dimensions) - 1 - i) for i, d in enumerate(dimensions))
            for row in rows:
                cell = tuple(row[d] if d in kept else None for d in dimensions) + (level,)
                count, users = cells.setdefault(cell, (0, set()))
                cells[cell] = (count + 1, users | ({row["user_id"]} - {None}))
    return {cell: (count, len(users)) for cell, (count, users) in cells.items()}


def test_cube_keeps_null_values_apart_from_totals(spark):
    rows = _rows(spark)
    found = {(r.x, r.y, r.level): (r.row_count, r.users) for r in cubes.exact_cube(rows, ["x", "y"]).collect()}
    assert found == _brute(rows.collect(), ["x", "y"])


def test_sketches_of_few_users_are_exact(spark):
    rows = _rows(spark)
    cells = cubes.user_cells(rows, ["x", "y"])
    found = {(r.x, r.y, r.level): (r.row_count, r.users) for r in cubes.cube_of_cells(cells, ["x", "y"]).collect()}
    assert found == _brute(rows.collect(), ["x", "y"])


def test_stored_states_merge_within_their_error(spark, tmp_path):
    rows = spark.range(200_000).select(
        (F.col("id") % 30).alias("day"), (F.col("id") % 3).alias("kind"), (F.col("id") * 7919 % 60_000).alias("user_id"))
    for half in (0, 1):
        cubes.user_cells(rows.where(F.col("day") % 2 == half), ["day", "kind"]).write.mode("append").parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    exact = {(r.kind, r.level): r for r in cubes.exact_cube(rows, ["kind"]).collect()}
    merged = {(r.kind, r.level): r for r in cubes.cube_of_cells(cells, ["kind"]).collect()}
    assert exact.keys() == merged.keys()
    for cell, row in merged.items():
        assert row.row_count == exact[cell].row_count
        assert abs(row.users - exact[cell].users) <= 0.04 * exact[cell].users


def test_empty_tables_give_no_cells(spark):
    none = _rows(spark).where("false")
    assert cubes.exact_cube(none, ["x", "y"]).count() == 0
    assert cubes.user_cells(none, ["x"]).count() == 0
