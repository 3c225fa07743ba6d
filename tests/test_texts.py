from __future__ import annotations

from difflib import get_close_matches

import pytest
from pyspark.sql import functions as F

from tallyshelf.functions.ordering import take
from tallyshelf.operators import columns, textlog
from tallyshelf.operators.textlog import clean_sql
from tallyshelf.plans.free_select import free_select
from tallyshelf.schemas import TABLES
from tests.tables import dicts


def routed(spark, *questions):
    df = spark.createDataFrame([(q,) for q in questions], "question string")
    return [(r["route"], r["sub_route"], r["row_limit"], r["threshold"])
            for r in dicts(textlog.route_questions(df))]


@pytest.mark.parametrize(("question", "expected"), [
    ("How many TOTAL CUSTOMERS in mg?", ("total_customers", None, None, None)),
    ("mg by city", ("payouts", None, 200, None)),
    ("Logistics inventory", ("payouts", None, 200, None)),
    ("omg inventory", ("inventory", "overview", 100, None)),
    ("top 7 most sold in inventory", ("inventory", "top_sold", 7, None)),
    ("best seller on hand", ("inventory", "top_sold", 5, None)),
    ("stockout threshold 3", ("inventory", "reorder", 100, 3)),
    ("inventory low stock less than 4", ("inventory", "reorder", 100, 4)),
    ("overstock", ("inventory", "slow", 100, 10)),
    ("slow-moving below 20", ("inventory", "slow", 100, 20)),
    ("monthly reorder", ("inventory", "monthly", None, None)),
    ("first 20 orders by descending value", ("orders_by_value", None, 20, None)),
    ("orders by highest value", ("orders_by_value", None, 500, None)),
    ("orders by value", ("none", None, None, None)),
    ("top 99999999999999999999 orders, highest value", ("orders_by_value", None, 2**63 - 1, None)),
    ("", ("none", None, None, None)),
    (None, ("none", None, None, None)),
])
def test_routes(spark, question, expected):
    assert routed(spark, question) == [expected]


@pytest.mark.parametrize(("reply", "expected"), [
    ("```sql\nSELECT 1\n```", "SELECT 1"),
    ("Here is the query: select a -- first; second\nfrom t; drop table t", "select a \nfrom t"),
    ("Sure, with pleasure: SELECT 1", "SELECT 1"),
    ("x WITH t AS (SELECT 1) SELECT * FROM t;", "WITH t AS (SELECT 1) SELECT * FROM t"),
    ("WITH recursive t AS ( SELECT 1) SELECT 2", "WITH recursive t AS ( SELECT 1) SELECT 2"),
    ("SELECT /* a;\nb */ 1", "SELECT  1"),
    ("/* note */ select 1", "select 1"),
    ("selection of rows", ""),
    ("DROP TABLE t", ""),
    ("", ""),
    (None, ""),
])
def test_clean_sql(spark, reply, expected):
    df = spark.createDataFrame([(reply,)], "reply string")
    assert dicts(textlog.clean_sql_log(df))[0]["sql"] == expected


def audited(spark, sql):
    df = spark.createDataFrame([(1, sql)], "query_id long, sql string")
    return [(r["table_name"], r["column_name"]) for r in dicts(columns.audit_columns(df))]


@pytest.mark.parametrize(("sql", "expected"), [
    ("SELECT o.order_id, O.Foo, orders.foo FROM orders o", [("orders", "foo")]),
    ("SELECT i.cost, m.x FROM inventory i, mg m", [("mg", "x")]),
    ("SELECT o.foo", [("orders", "foo")]),
    ("SELECT m.year_month FROM monthly m", []),
    ("WITH m AS (SELECT 1 AS z) SELECT m.z FROM m", []),
    ("SELECT x.foo FROM orders AS x JOIN inventory y ON x.product_id = y.prod",
     [("orders", "foo"), ("inventory", "prod")]),
    ("SELECT orders.bar FROM orders WHERE 1.5 < 2.5", [("orders", "bar")]),
    ("SELECT orders.bar FROM orders JOIN inventory i ON i.bad = 1",
     [("orders", "bar"), ("inventory", "bad")]),
    ("SELECT foo FROM orders", []),
    (None, []),
])
def test_audit(spark, sql, expected):
    assert sorted(audited(spark, sql)) == sorted(expected)


def expected_suggestions(table, word):
    """The rule spelled out for one name, with the standard library's matcher."""
    spec = TABLES[table]
    names = spec.columns
    by_synonym = [c for c, words in spec.synonyms.items() if word in (c, *words)]
    by_part = [c for c in names if word in c or c in word]
    by_shape = get_close_matches(word, names, n=5, cutoff=0.6)
    return list(dict.fromkeys(by_synonym + by_part + by_shape))[:5]


def test_suggestions_equal_the_rule(spark):
    words = {
        "orders": ["customer", "amount", "sale_prise", "created", "statuses", "at", "zzz", "id",
                   "product", "order", "shiped_at", "usr_id"],
        "inventory": ["pid", "brand", "unit_cost", "produkt_name", "product_nmae", "sold"],
        "mg": ["vendor", "penalty", "total_payut", "attendence", "eligible", "monthly", "final"],
    }
    pairs = [(t, w) for t, ws in words.items() for w in ws]
    missing = spark.createDataFrame(pairs * 3, "table_name string, column_name string")
    got: dict = {}
    for r in sorted(dicts(columns.suggest_columns(missing, similarity="gestalt")), key=lambda r: r["rank"]):
        got.setdefault((r["table_name"], r["column_name"]), []).append(r["suggestion"])
    for table, word in pairs:
        assert got.get((table, word), []) == expected_suggestions(table, word), (table, word)


def test_suggestion_sample(spark):
    missing = spark.createDataFrame([("orders", "Amount ")], "table_name string, column_name string")
    samples = spark.createDataFrame(
        [("orders", "sale_price", "12.5")], "table_name string, column_name string, sample string")
    row = dicts(columns.suggest_columns(missing, samples, "levenshtein"))[0]
    assert (row["suggestion"], row["sample"], row["rank"]) == ("sale_price", "12.5", 1)
    with pytest.raises(ValueError, match="unknown similarity"):
        columns.suggest_columns(missing, similarity="other")


def test_named_queries_keep_their_start(spark):
    replies = ["Sure: WITH t(a) AS (SELECT 1) SELECT a FROM t", 'WITH "t" AS (SELECT 1 AS a) SELECT a FROM "t"',
               "WITH t AS MATERIALIZED (SELECT 1 AS a) SELECT a FROM t"]
    rows = spark.createDataFrame([(r,) for r in replies], "reply string").select(clean_sql(F.col("reply")).alias("sql")).collect()
    assert all(r.sql.upper().startswith("WITH") for r in rows)


def test_free_select_only_reads(spark, tmp_path):
    target = tmp_path / "out"
    for text in ("", "  ;", "DROP TABLE t", f"WITH t AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '{target}' USING parquet SELECT * FROM t"):
        with pytest.raises(ValueError):
            free_select(spark, text)
    assert not target.exists()
    assert free_select(spark, "WITH t AS (SELECT 1 AS a, 2 AS a) SELECT * FROM t ORDER BY 1;").count() == 1


def test_limit_is_never_left_out(spark):
    with pytest.raises(ValueError):
        take(spark.range(3), [F.col("id")], 2**31)
