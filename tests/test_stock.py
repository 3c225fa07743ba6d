from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import sales, stock
from tallyshelf.sources import warehouse
from tests.tables import day, dicts, table

D = day("2024-03-05")


def unit(product, sold=None, **more):
    return {"product_id": product, "sold_at": sold, **more}


@pytest.fixture(scope="module")
def orders(spark):
    return table(spark, "orders", [
        {"product_id": 1, "created_at": day("2024-01-10")},
        {"product_id": 1, "created_at": day("2024-01-31 23:59:59")},
        {"product_id": 1, "created_at": None},
        {"product_id": 3, "created_at": day("2024-02-01")},
        {"product_id": None, "created_at": day("2024-02-02")},
        {"product_id": 4, "created_at": day("2024-02-03")},
    ])


@pytest.fixture(scope="module")
def inventory(spark):
    return table(spark, "inventory", [
        unit(2, product_name="b", product_brand="x"), unit(2, product_name=None),
        unit(3, D, product_name="c"), unit(3, D, product_name="d"),
        unit(None, product_name="nobody"),
        *[unit(4, product_name="slow") for _ in range(12)],
        *[unit(5, product_name="edge") for _ in range(10)],
    ])


def by_product(df):
    return {r["product_id"]: r for r in dicts(df)}


def test_position(orders, inventory):
    got = by_product(stock.stock_position(orders, inventory))
    assert set(got) == {1, 2, 3, 4, 5}
    assert (got[1]["units_sold"], got[1]["on_hand"], got[1]["product_name"]) == (3, 0, None)
    assert (got[2]["units_sold"], got[2]["on_hand"]) == (0, 2)
    assert (got[2]["product_name"], got[2]["product_brand"]) == ("b", "x")
    assert (got[3]["units_sold"], got[3]["on_hand"], got[3]["product_name"]) == (1, 0, "d")


def test_star_form_equals_flat_form(spark, orders, inventory):
    attributes = inventory.select("product_id", *stock.ATTRIBUTES)
    unsold_product = spark.createDataFrame(
        [(99, "never seen", None, None), (1, "not in inventory", None, None)], attributes.schema
    )
    products = attributes.unionByName(unsold_product)
    for report in (stock.stock_position, stock.top_sold, stock.reorder, stock.slow_movers,
                   stock.stock_overview):
        flat, star = report(orders, inventory), report(orders, inventory, products=products)
        assert dicts(flat.orderBy("product_id")) == dicts(star.orderBy("product_id"))
    many = stock.top_sold(orders, inventory, n=200_000, products=products)
    assert dicts(many) == dicts(stock.top_sold(orders, inventory, n=200_000))
    flat = stock.monthly_units_stock(orders, inventory)
    monthly = stock.monthly_units_stock(orders, inventory, products.where("product_id <> 1"))
    assert dicts(flat) == dicts(monthly)


def test_default_bounds(orders, inventory):
    assert [r["product_id"] for r in dicts(stock.slow_movers(orders, inventory))] == [4, 5]
    assert [r["product_id"] for r in dicts(stock.reorder(orders, inventory))] == [1, 3, 2]
    assert [r["product_id"] for r in dicts(stock.top_sold(orders, inventory, 2))] == [1, 3]
    overview = [r["product_id"] for r in dicts(stock.stock_overview(orders, inventory))]
    assert overview == [1, 3, 4, 2, 5]


def test_monthly_units_leave_out_undated_items(orders, inventory):
    got = dicts(stock.monthly_units_stock(orders, inventory))
    assert [(r["year_month"], r["product_id"], r["units_sold"], r["on_hand"]) for r in got] == [
        (day("2024-02-01"), 3, 1, 0), (day("2024-02-01"), 4, 1, 12), (day("2024-01-01"), 1, 2, 0),
    ]
    assert [r["product_name"] for r in got] == ["d", "slow", None]


def test_no_orders(spark, inventory):
    got = by_product(stock.stock_position(table(spark, "orders", []), inventory))
    assert set(got) == {2, 3, 4, 5}
    assert all(r["units_sold"] == 0 for r in got.values())


def test_totals_on_given_tables(spark, folder):
    orders, inventory = warehouse.orders(spark, folder), warehouse.inventory(spark, folder)
    sums = stock.stock_position(orders, inventory).agg(
        F.sum("units_sold"), F.sum("on_hand"), F.count("*"), F.count_distinct("product_id")
    ).first()
    known = orders.where("product_id IS NOT NULL")
    assert sums[0] == known.count()
    assert sums[1] == inventory.where("product_id IS NOT NULL AND sold_at IS NULL").count()
    assert sums[2] == sums[3]
    units = sales.monthly_units(orders).agg(F.sum("units")).first()[0]
    assert units == known.where("created_at IS NOT NULL").count()
