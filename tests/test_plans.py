"""What the physical plans must and must not contain, with broadcast joins off where size matters."""

from __future__ import annotations

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tallyshelf.operators import analyses, sales, stock
from tallyshelf.session import tune
from tallyshelf.sources import warehouse
from tests.tables import dicts

WRITES_FILES = {name for name in queries() if name.startswith(("load_", "stream_"))}
USES_PYTHON: set[str] = {"status_runs"}  # a table function that holds one run
NARROW = {"enforce_schema", "coerce_types", "nan_to_null"}
TEXT_JOBS = {"route_questions", "clean_sql_log", "audit_columns"}


@contextmanager
def settings(spark, **values):
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def large_tables(spark):
    return settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df) -> str:
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def scans(plan: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet .*{table}\.parquet", plan))


@pytest.fixture(scope="module")
def plans(spark, folder):
    tune(spark)
    return {n: plan_of(q(spark, folder)) for n, q in queries().items() if n not in WRITES_FILES}


def test_no_cross_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_no_python_but_where_it_is_named(plans):
    for name, plan in plans.items():
        assert ("Python" in plan) == (name in USES_PYTHON), name


def test_top_k_needs_no_global_sort(plans):
    for name in ("top_sold", "reorder", "slow_movers", "slow_movers_60d", "stock_overview",
                 "orders_by_value", "payouts", "preview", "ask_top_orders", "ask_reorder", "reorder_as_of",
                 "reply_recent"):
        assert "TakeOrderedAndProject" in plans[name], name
        assert "rangepartitioning" not in plans[name], name


def test_text_jobs_do_not_shuffle(plans):
    for name in TEXT_JOBS:
        assert "Exchange" not in plans[name], name
    for name in NARROW:
        assert "hashpartitioning" not in plans[name], name


def test_stock_reports_read_few_columns_once(plans):
    plan = plans["stock_position"]
    assert scans(plan, "lineitem") == 2 and scans(plan, "part") == 1
    assert scans(plan, "orders") == 0
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)) <= {
        "struct<l_partkey:bigint>",
        "struct<l_partkey:bigint,l_linestatus:string,l_shipdate:timestamp_ntz>",
    } | set(re.findall(r"ReadSchema: (struct<p_[^>]*>)", plan))


def test_all_rows_are_hash_aggregated(spark, folder):
    """Text maxima are sorted aggregates; they must only see grouped rows."""
    orders, inventory = warehouse.orders(spark, folder), warehouse.inventory(spark, folder)
    for report in (stock.stock_position(orders, inventory),
                   stock.monthly_units_stock(orders, inventory)):
        lines = plan_of(report).splitlines()
        for i, line in enumerate(lines):
            if "SortAggregate" in line and "partial_max" in line:
                below = "\n".join(lines[i + 1: i + 4])
                assert "HashAggregate" in below, below


def test_counts_are_shared_by_both_uses_of_a_top_k(spark, folder):
    with large_tables(spark):
        plan = final_plan_of(queries()["top_sold"](spark, folder))
    assert "ReusedExchange" in plan
    assert scans(plan, "lineitem") == 2 and scans(plan, "part") == 1
    assert "SortMergeJoin" not in plan


def test_rows_are_combined_before_they_are_shuffled(spark, folder):
    """Below each exchange that feeds a grouping by product there is a partial aggregate."""
    orders = warehouse.order_lines(spark, folder)
    plan = plan_of(stock.stock_counts(orders, warehouse.inventory_units(spark, folder)))
    exchange = plan.index("Exchange hashpartitioning(product_id")
    assert "partial_sum" in plan[exchange:] and plan.count("Exchange") == 1


def test_hot_join_keys_are_split(spark, folder):
    """A third of all lines on one order: its join partition is split, the result is whole."""
    # A partition is split by the tasks that wrote it, and the given file is read by one task.
    lines = warehouse.order_lines(spark, folder).repartition(8)
    hot = F.pmod(F.xxhash64("order_id", "inventory_item_id", "shipped_at"), F.lit(3)) == 0
    skewed = lines.withColumn("order_id", F.when(hot, 1).otherwise(F.col("order_id")).cast("bigint"))
    orders = skewed.join(warehouse.order_headers(spark, folder), "order_id")
    expected = {
        (r["month"], r["units"]) for r in dicts(analyses.monthly_trend(orders))
    }
    with large_tables(spark), settings(
        spark,
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="50k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20k",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__shuffle__partitions="16",
    ):
        trend = analyses.monthly_trend(orders)
        got = {(r["month"], r["units"]) for r in dicts(trend)}
        plan = plan_of(trend).split("== Initial Plan ==")[0]
    assert got == expected
    assert "skew=true" in plan


def test_large_limits_do_not_hold_rows_in_memory(spark, folder):
    tune(spark)
    lines = warehouse.order_lines(spark, folder)
    assert "TakeOrderedAndProject" in plan_of(sales.orders_by_value(lines, 100_000 - 1))
    many = sales.orders_by_value(lines, 50_000_000)
    assert "TakeOrderedAndProject" not in plan_of(many)
    assert many.count() == lines.count()
