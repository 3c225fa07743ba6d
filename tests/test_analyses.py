from __future__ import annotations

import statistics
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from tallyshelf.operators import analyses, profile
from tallyshelf.plans.free_select import free_select, isolated_session, register
from tallyshelf.sources import warehouse
from tests.tables import day, dicts, table


@pytest.fixture(scope="module")
def orders(spark):
    return table(spark, "orders", [
        {"order_id": 1, "user_id": 1, "product_id": 1, "sale_price": 0.1, "created_at": day("2024-01-05")},
        {"order_id": 1, "user_id": 1, "product_id": 1, "sale_price": 0.2, "created_at": day("2024-01-31")},
        {"order_id": 2, "user_id": 1, "product_id": 2, "sale_price": 5.0, "created_at": day("2024-03-01")},
        {"order_id": 3, "user_id": 2, "product_id": 1, "sale_price": None, "created_at": day("2024-03-02")},
        {"order_id": 4, "user_id": None, "product_id": None, "sale_price": 1.0, "created_at": None},
    ])


def test_trend(orders):
    got = [tuple(r.values()) for r in dicts(analyses.monthly_trend(orders))]
    assert got == [
        (day("2024-01-01"), 1, 2, 0.3, None), (day("2024-03-01"), 2, 2, 5.0, 4.7)]


def test_last_days(orders):
    assert analyses.last_days(orders, 1).count() == 1
    assert analyses.last_days(orders, 31).count() == 2  # the bound itself is outside
    assert analyses.last_days(orders, 32).count() == 3
    assert analyses.last_days(orders, 365).count() == 4


def test_retention(orders):
    got = [tuple(r.values()) for r in dicts(analyses.retention(orders))]
    assert got == [(day("2024-01-01"), 0, 1), (day("2024-01-01"), 2, 1), (day("2024-03-01"), 0, 1)]


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_segments_match_ranks(spark, folder, accuracy):
    rows = dicts(analyses.user_segments(warehouse.orders(spark, folder), 4, accuracy))
    spends = sorted(r["spend"] for r in rows)
    n = len(spends)
    cuts = [spends[-(-n * i // 4) - 1] for i in (1, 2, 3)]
    for r in rows:
        assert r["segment"] == 1 + sum(r["spend"] > cut for cut in cuts)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["segment"]] += 1
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_segments_with_many_equal_spends(spark):
    prices = [5.0] * 40 + [1.0, 2.0, 3.0] * 5 + [9.0] * 20
    orders = table(spark, "orders", [
        {"user_id": i, "sale_price": p} for i, p in enumerate(prices)])
    for segments, accuracy in ((3, 10), (5, 1000), (2, 10_000)):
        ranked = sorted(prices)
        cuts = [ranked[-(-len(prices) * i // segments) - 1] for i in range(1, segments)]
        for r in dicts(analyses.user_segments(orders, segments, accuracy)):
            assert r["segment"] == 1 + sum(r["spend"] > cut for cut in cuts)


def test_segments_without_price(orders):
    got = {r["user_id"]: (r["spend"], r["segment"]) for r in dicts(analyses.user_segments(orders, 2))}
    assert got[2] == (None, None) and got[1][0] == 5.3


def test_anomalies(spark):
    units = [2, 2, 2, 2, 3, 2, 2, 20]
    rows = [
        {"product_id": 1, "created_at": day(f"2024-{m:02d}-01")}
        for m, n in enumerate(units, start=1) for _ in range(n)
    ] + [{"product_id": 2, "created_at": day("2024-01-01")}]
    got = dicts(analyses.unit_anomalies(table(spark, "orders", rows)))
    z = (20 - statistics.mean(units)) / statistics.stdev(units)
    assert [(r["month"], r["units"]) for r in got] == [(day("2024-08-01"), 20)]
    assert got[0]["z_score"] == pytest.approx(z, abs=1e-6)


def test_quality_checks(spark, orders):
    inventory = table(spark, "inventory", [
        {"product_id": 1, "created_at": day("2024-01-02"), "sold_at": day("2024-01-01")}])
    mg = table(spark, "mg", [{"month": "2024-01", "id_user": 1}] * 3 + [{"id_user": 9}])
    rows = dicts(analyses.dq_checks(orders, inventory, mg))
    got = {(r["check_name"], r["table_name"], r["column_name"]): (r["failed"], r["checked"])
           for r in rows}
    assert got["null", "orders", "sale_price"] == (1, 5)
    assert got["orphan_key", "orders", "product_id"] == (1, 4)
    assert got["duplicate_key", "mg", "month,id_user"] == (2, 3)
    assert got["duplicate_key", "orders", "order_id,inventory_item_id"] == (0, 0)
    assert got["before_created_at", "inventory", "sold_at"] == (1, 1)


def test_manifest_and_shapes(spark, orders):
    tables = {"orders": orders, "empty": orders.where("order_id < 0")}
    manifest = {(r["table_name"], r["column_name"]): r
                for r in dicts(profile.column_manifest(tables))}
    price = manifest["orders", "sale_price"]
    assert (price["data_type"], price["has_nulls"], price["sample"]) == ("double", True, "0.1")
    assert manifest["orders", "created_at"]["sample"] == "2024-01-05 00:00:00"
    assert manifest["empty", "order_id"]["has_nulls"] is False
    assert manifest["empty", "order_id"]["sample"] is None
    skipped = profile.column_manifest(tables, no_sample=(T.DoubleType,)).where("sample IS NULL")
    assert ("orders", "sale_price") in {(r["table_name"], r["column_name"]) for r in dicts(skipped)}
    shapes = {r["table_name"]: (r["row_count"], r["column_count"])
              for r in dicts(profile.table_shapes(tables))}
    assert shapes == {"orders": (5, 11), "empty": (0, 11)}


def test_long_samples_are_cut(spark):
    long = table(spark, "orders", [{"status": "x" * 200}])
    sample = {r["column_name"]: r["sample"] for r in dicts(profile.column_manifest({"o": long}))}
    assert sample["status"] == "x" * 40
    sample = {r["column_name"]: r["sample"] for r in dicts(profile.column_samples({"o": long}))}
    assert sample["status"] == "x" * 80


def test_free_select(spark, folder):
    child = register(warehouse.tables(isolated_session(spark), folder))
    assert free_select(child, " SELECT COUNT(*) AS n FROM orders; ").first().n == 60_000
    assert not spark.catalog.tableExists("orders")
    with pytest.raises(ValueError):
        free_select(child, "DROP VIEW orders")
    with pytest.raises(Exception, match="nowhere"):
        free_select(child, "SELECT nowhere FROM orders")
