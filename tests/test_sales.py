from __future__ import annotations

from tallyshelf.functions.ordering import desc, sort_copies, then_by_rest
from tallyshelf.operators import payouts, profile, sales
from tallyshelf.plans.ask import ask
from tests.tables import day, dicts, table


def test_nulls_sort_last(spark):
    orders = table(spark, "orders", [
        {"order_id": 1, "sale_price": None, "created_at": day("2024-01-02")},
        {"order_id": 2, "sale_price": 5.0, "created_at": None},
        {"order_id": 4, "sale_price": 7.0, "created_at": day("2024-01-03")},
        {"order_id": 3, "sale_price": 7.0, "created_at": day("2024-01-01")},
    ])
    assert [r["order_id"] for r in dicts(sales.orders_by_value(orders))] == [3, 4, 2, 1]
    assert [r["order_id"] for r in dicts(sales.orders_by_value(orders, 1))] == [3]
    assert [r["order_id"] for r in dicts(sales.orders_recent(orders))] == [4, 1, 3, 2]
    assert [r["order_id"] for r in dicts(sales.orders_recent(orders, 2))] == [4, 1]


def test_payouts_unknown_last(spark):
    mg = table(spark, "mg", [
        {"id_user": 1, "month": "2024-01", "total_payout": None},
        {"id_user": 3, "month": "2024-02", "total_payout": 4.0},
        {"id_user": 3, "month": "2024-01", "total_payout": 4.0},
        {"id_user": 2, "month": "2024-01", "total_payout": -1.0},
    ])
    got = dicts(payouts.payouts(mg))
    assert [(r["id_user"], r["month"]) for r in got] == [
        (3, "2024-01"), (3, "2024-02"), (2, "2024-01"), (1, "2024-01")]
    assert list(got[0]) == payouts.PAYOUT_COLUMNS


def test_total_customers_ignores_null_and_repeats(spark):
    orders = table(spark, "orders", [{"user_id": u} for u in (1, 1, 2, None, None)])
    assert sales.total_customers(orders).first()[0] == 2
    assert sales.total_customers_approx(orders).first()[0] == 2


def test_preview(spark):
    orders = table(spark, "orders", [{"order_id": i} for i in range(60)])
    got = dicts(profile.preview(orders, [desc("order_id")]))
    assert len(got) == 50 and got[0]["order_id"] == 59
    assert {r["total_rows"] for r in got} == {60}
    assert dicts(profile.preview(orders.where("order_id < 0"), [desc("order_id")])) == []


def test_copies_are_kept_and_spread(spark, monkeypatch):
    monkeypatch.setattr("tallyshelf.functions.ordering._COPIES_PER_ROW", 10)
    orders = table(spark, "orders", [{"order_id": 1}] * 95 + [{"order_id": i} for i in range(2, 50)])
    ordered = sort_copies(orders, [desc("order_id"), *then_by_rest(orders, ["order_id"])])
    ids = [r["order_id"] for r in dicts(ordered)]
    assert ids == sorted(ids, reverse=True)
    assert ids.count(1) == 95 and len(ids) == 143


def test_ask(spark):
    tables = {
        "orders": table(spark, "orders", [
            {"order_id": i, "user_id": i % 3, "product_id": i, "sale_price": float(i),
             "created_at": day("2024-01-01")} for i in range(1, 8)]),
        "inventory": table(spark, "inventory", [
            {"product_id": p} for p in [1] * 12 + [2] * 3]),
        "mg": table(spark, "mg", [{"id_user": 1, "total_payout": 2.0}]),
    }
    assert ask("How many total customers?", tables).first()[0] == 3
    top = dicts(ask("Top 2 orders by highest value", tables))
    assert [r["order_id"] for r in top] == [7, 6]
    assert dicts(ask("mg payouts", tables))[0]["total_payout"] == 2.0
    assert [r["product_id"] for r in dicts(ask("slow moving stock", tables))] == [1]
    assert len(dicts(ask("inventory reorder below 4", tables))) == 6
    assert len(dicts(ask("top 3 best seller in inventory", tables))) == 3
    assert len(dicts(ask("monthly inventory", tables))) == 7
    assert len(dicts(ask("inventory", tables))) == 7
    assert len(dicts(ask("what is new?", tables))) == 7
