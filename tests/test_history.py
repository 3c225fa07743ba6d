"""Reports as of an instant, and stock over time."""

from __future__ import annotations

import datetime as dt

import pytest

from tallyshelf.functions.as_of import instant, inventory_at, mg_at, orders_at
from tallyshelf.operators import analyses, history, payouts, sales, stock
from tallyshelf.plans.ask import ask, reply
from tests.tables import day, dicts, table


@pytest.fixture(scope="module")
def units(spark):
    rows = [
        {"id": 1, "product_id": 1, "created_at": day("2024-01-10"), "sold_at": day("2024-03-05"), "product_name": "a"},
        {"id": 2, "product_id": 1, "created_at": day("2024-01-20"), "sold_at": None, "product_name": "a"},
        {"id": 3, "product_id": 1, "created_at": day("2024-03-01"), "sold_at": day("2024-03-01"), "product_name": "b"},
        {"id": 4, "product_id": 2, "created_at": day("2024-02-01"), "sold_at": None},
        {"id": 5, "product_id": None, "created_at": day("2024-02-01"), "sold_at": None},
        {"id": 6, "product_id": 2, "created_at": None, "sold_at": day("2024-02-01")},
    ]
    return table(spark, "inventory", rows)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        {"id": 1, "order_id": 1, "user_id": 7, "product_id": 1, "created_at": day("2024-02-15"), "shipped_at": day("2024-03-20"), "sale_price": 5.0},
        {"id": 2, "order_id": 2, "user_id": 8, "product_id": 1, "created_at": day("2024-03-05"), "sale_price": 9.0},
        {"id": 3, "order_id": 3, "user_id": 9, "product_id": 3, "created_at": None, "sale_price": 99.0},
    ]
    return table(spark, "orders", rows)


def position(rows):
    return {r["product_id"]: (r["units_sold"], r["on_hand"]) for r in rows}


def test_stock_as_of(items, units):
    at = lambda when: position(dicts(stock.stock_position(items, units, as_of=when)))
    assert at("2024-01-15") == {1: (0, 1)}
    assert at("2024-03-01") == {1: (1, 2), 2: (0, 1)}
    assert at(dt.date(2024, 3, 5)) == {1: (2, 1), 2: (0, 1)}
    assert at("2020-01-01") == {}
    assert position(dicts(stock.reorder(items, units, threshold=2, as_of="2024-03-01"))) == {2: (0, 1)}
    assert position(dicts(stock.top_sold(items, units, 1, as_of="2024-03-05"))) == {1: (2, 1)}
    assert position(dicts(stock.slow_movers(items, units, threshold=1, as_of="2024-03-01"))) == {1: (1, 2), 2: (0, 1)}


def test_instants_do_not_depend_on_the_time_zone(spark, items):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ask_at = lambda when: spark.range(1).select(instant(when)).first()[0]
        assert ask_at("2024-03-10T02:30:00") == dt.datetime(2024, 3, 10, 2, 30)
        assert ask_at("2024-03-05T00:00:00+05:30") == dt.datetime(2024, 3, 4, 18, 30)
        assert orders_at(items, "2024-03-05").count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_later_steps_are_not_known(items, units):
    assert [r["shipped_at"] for r in dicts(orders_at(items, "2024-03-01"))] == [None]
    assert {r["id"]: r["sold_at"] for r in dicts(inventory_at(units, "2024-03-01"))} == {
        1: None, 2: None, 3: day("2024-03-01"), 4: None, 5: None}
    assert orders_at(items, None) is items


def test_sales_payouts_and_answers_as_of(spark, items, units):
    mg = table(spark, "mg", [{"month": "2024-01", "id_user": 1}, {"month": "2024-02", "id_user": 2}, {"month": None, "id_user": 3}])
    assert [r["id_user"] for r in dicts(mg_at(mg, "2024-01-31"))] == [1]
    assert [r["id_user"] for r in dicts(payouts.payouts(mg, as_of="2024-02-01"))] == [1, 2]
    assert sales.total_customers(items, as_of="2024-03-01").first()[0] == 1
    assert [r["id"] for r in dicts(sales.orders_recent(items, as_of="2024-03-05"))] == [2, 1]
    assert [r["id"] for r in dicts(sales.orders_by_value(items, 1, as_of="2024-03-05"))] == [2]
    assert sales.monthly_units(items, as_of="2024-03-01").count() == 1
    assert [r["id"] for r in dicts(analyses.last_days(items, 10, as_of="2024-02-20"))] == [1]
    tables = {"orders": items, "inventory": units, "mg": mg}
    assert position(dicts(ask("top 1 most sold items in inventory", tables, as_of="2024-03-01"))) == {1: (1, 2)}
    shown = dicts(reply("nothing known", tables, n=1))
    assert [(r["id"], r["total_rows"]) for r in shown] == [(2, 3)]
    assert dicts(reply("nothing known", {**tables, "orders": items.limit(0)})) == []


def test_a_listing_is_shown_as_a_top_k(items, units, spark):
    tables = {"orders": items, "inventory": units, "mg": table(spark, "mg", [])}
    plan = reply("nothing known", tables)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_monthly_stock(units):
    found = {(r["product_id"], str(r["month"])[:7]): (r["received"], r["sold"], r["on_hand"]) for r in dicts(history.monthly_stock(units))}
    assert found == {(1, "2024-01"): (2, 0, 2), (1, "2024-03"): (1, 2, 1), (2, "2024-02"): (1, 0, 1)}
    assert history.monthly_stock(units.limit(0)).collect() == []


def test_monthly_units_with_the_stock_of_the_month(items, units):
    found = [(str(r["year_month"])[:7], r["product_id"], r["units_sold"], r["on_hand"], r["product_name"])
             for r in dicts(history.monthly_units_then(items, units))]
    assert found == [("2024-03", 1, 1, 1, "b"), ("2024-02", 1, 1, 2, "b")]


def test_events_are_summed_before_the_window(units):
    plan = history.monthly_stock(units)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("HashAggregate") < plan.index("Exchange hashpartitioning(product_id", plan.index("partial_sum") - 400)
