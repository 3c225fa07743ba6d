"""A question in words, answered by the report it is routed to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.as_of import Instant, tables_at
from tallyshelf.functions.ordering import desc, then_by_rest
from tallyshelf.operators import payouts, sales, stock
from tallyshelf.operators.profile import PREVIEW_ROWS
from tallyshelf.operators.textlog import route_questions


def reply(
    question: str, tables: dict[str, DataFrame], n: int = PREVIEW_ROWS, as_of: Instant | None = None
) -> DataFrame:
    """What a questioner is shown: the first ``n`` rows of the answer, each with the row count of all of it.

    The limit meets the report's own sort, so a long listing is a top-k and not sorted as a whole. No rows: no matching data.
    """
    answer = ask(question, tables, as_of)
    total = answer.agg(F.count("*")).scalar()
    return answer.limit(n).withColumn("total_rows", total)


def ask(question: str, tables: dict[str, DataFrame], as_of: Instant | None = None) -> DataFrame:
    """The report for one question over ``orders``, ``inventory`` and ``mg``, as of an instant if one is given.

    A question that fits no report gets the order listing, newest first. The route is worked out
    by the same expressions that label whole question logs.
    """
    tables = tables_at(tables, as_of)
    orders, inventory, mg = tables["orders"], tables["inventory"], tables["mg"]
    asked = orders.sparkSession.sql("SELECT :asked AS question", args={"asked": question})
    label = route_questions(asked).first()
    if label.route == "total_customers":
        return sales.total_customers(orders)
    if label.route == "payouts":
        return payouts.payouts(mg, label.row_limit)
    if label.route == "orders_by_value":
        return sales.orders_by_value(orders, label.row_limit)
    if label.route == "none":
        return orders.orderBy(desc("created_at"), *then_by_rest(orders, ["created_at"]))
    if label.sub_route == "monthly":
        return stock.monthly_units_stock(orders, inventory)
    if label.sub_route == "top_sold":
        return stock.top_sold(orders, inventory, label.row_limit)
    if label.sub_route == "reorder":
        return stock.reorder(orders, inventory, label.threshold)
    if label.sub_route == "slow":
        return stock.slow_movers(orders, inventory, label.threshold)
    return stock.stock_overview(orders, inventory)
