from __future__ import annotations

import datetime as dt
from itertools import groupby

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyshelf.functions.positions import DAY
from tallyshelf.operators.runs import state_runs

SCHEMA = "product_id bigint, status string, at timestamp_ntz, item bigint, extra int, key int, bucket int"
START = dt.datetime(2024, 1, 1)


def _runs(spark, rows, width):
    table = spark.createDataFrame([(p, s, None if d is None else START + dt.timedelta(days=d), i, 0, 0, 0) for p, s, d, i in rows], SCHEMA)
    found = state_runs(table, "product_id", "status", "at", "item", width * DAY)
    return sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[1]))


def _brute(rows):
    out = []
    known = [r for r in rows if None not in (r[0], r[2], r[3])]
    known.sort(key=lambda r: (r[0], r[2], r[3], r[1] is not None, r[1] or ""))
    for product, own in groupby(known, key=lambda r: r[0]):
        for run, (status, items) in enumerate(groupby(own, key=lambda r: r[1]), 1):
            items = list(items)
            days = [START + dt.timedelta(days=r[2]) for r in items]
            out.append((product, run, status, days[0], days[-1], len(items)))
    return out


def test_runs_across_buckets(spark):
    rows = [(1, "F", 0, 1), (1, "F", 9, 2), (1, "F", 40, 3), (1, "O", 41, 4), (1, None, 42, 5), (1, None, 80, 6), (1, "O", 81, 7), (2, "F", 0, 8)]
    assert _runs(spark, rows, 10) == _brute(rows)


def test_no_rows(spark):
    assert _runs(spark, [(None, "F", 0, 1), (1, "F", None, 1), (1, "F", 0, None)], 10) == []


ROW = st.tuples(st.sampled_from([1, 2, None]), st.sampled_from(["F", "O", None]), st.integers(0, 12), st.integers(0, 3))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, max_size=40))
def test_equals_grouping_in_order(spark, rows):
    assert _runs(spark, rows, 3) == _brute(rows)


def test_runs_across_arrow_batches(spark):
    rows = [(p, "FFOF"[d * p % 4] if d % 9 else None, d // 2, d) for p in range(1, 12) for d in range(30)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert _runs(spark, rows, 5) == _brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_states_of_any_type(spark):
    rows = [(1, s, START + dt.timedelta(days=d), d) for d, s in enumerate([(1, "a"), (1, "a"), (1, None), None, None, (1, "a")])]
    table = spark.createDataFrame(rows, "product_id bigint, status struct<x int, y string>, at timestamp_ntz, item bigint")
    found = state_runs(table, "product_id", "status", "at", "item", 10 * DAY).collect()
    assert sorted((r.run, None if r.status is None else tuple(r.status), r["items"]) for r in found) == [
        (1, (1, "a"), 2), (2, (1, None), 1), (3, None, 2), (4, (1, "a"), 1)]


def test_the_table_function_takes_whole_batches(spark):
    """No call per row, and none per key and bucket, of which most hold a row or two."""
    plan = state_runs(spark.createDataFrame([], SCHEMA), "product_id", "status", "at", "item")._jdf.queryExecution().executedPlan().toString()
    function = plan[plan.index("ArrowEvalPythonUDTF"):]
    assert function.splitlines()[0].rstrip().endswith(", 302") and "Sort [key" in function and "bucket" in function.split("Sort [key", 1)[1].splitlines()[0]


def test_a_popular_key_is_dealt_by_time(spark):
    table = spark.createDataFrame([], SCHEMA)
    plan = state_runs(table, "product_id", "status", "at", "item")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "bucket" in plan.split("hashpartitioning(", 1)[1]
