"""Order listings, monthly units and distinct customers; with ``as_of`` those of that instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.as_of import Instant, orders_at
from tallyshelf.functions.calendar import month_start
from tallyshelf.functions.ordering import asc, desc, sort_copies, take, then_by_rest

# Default row limits.
BY_VALUE_ROWS = 500


def orders_by_value(orders: DataFrame, n: int = BY_VALUE_ROWS, as_of: Instant | None = None) -> DataFrame:
    """The ``n`` order items of highest price."""
    orders = orders_at(orders, as_of)
    return take(orders, [desc("sale_price"), *then_by_rest(orders, ["sale_price"])], n)


def orders_recent(orders: DataFrame, n: int | None = None, as_of: Instant | None = None) -> DataFrame:
    """Order items, newest first; all of them unless ``n`` is given."""
    orders = orders_at(orders, as_of)
    keys = [desc("created_at"), *then_by_rest(orders, ["created_at"])]
    return sort_copies(orders, keys) if n is None else take(orders, keys, n)


def monthly_counts(orders: DataFrame) -> DataFrame:
    """``month, product_id, units`` over dated order items with a product, in no order."""
    dated = orders.where(F.col("created_at").isNotNull() & F.col("product_id").isNotNull())
    return dated.groupBy(month_start(F.col("created_at")).alias("month"), "product_id").agg(
        F.count("*").alias("units")
    )


def monthly_units(orders: DataFrame, as_of: Instant | None = None) -> DataFrame:
    """Units per month and product, latest month first."""
    return monthly_counts(orders_at(orders, as_of)).orderBy(desc("month"), asc("product_id"))


def total_customers(orders: DataFrame, as_of: Instant | None = None) -> DataFrame:
    """One number: distinct users that ordered."""
    return orders_at(orders, as_of).agg(F.count_distinct("user_id").alias("total_customers"))


def total_customers_approx(orders: DataFrame, error: float = 0.01) -> DataFrame:
    """The same within a relative ``error``, from one sketch per task instead of a shuffle."""
    return orders.agg(F.approx_count_distinct("user_id", error).alias("total_customers"))
