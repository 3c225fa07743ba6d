"""Trends, segments, anomalies, data quality and retention over the declared tables.

For those of an earlier instant pass the tables of ``functions.as_of``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.as_of import Instant, instant, orders_at
from tallyshelf.functions.calendar import month_number, month_start
from tallyshelf.functions.ordering import asc, desc
from tallyshelf.operators.sales import monthly_counts


def _money(column: str) -> Column:
    """Exact addends, so a total does not depend on the order of addition."""
    return F.col(column).cast("decimal(18,2)")


def monthly_trend(orders: DataFrame) -> DataFrame:
    """Orders, items and revenue per month, and the change in revenue on the month before."""
    monthly = (
        orders.where(F.col("created_at").isNotNull())
        .groupBy(month_start(F.col("created_at")).alias("month"))
        .agg(
            F.count_distinct("order_id").alias("order_count"),
            F.count("*").alias("units"),
            F.sum(_money("sale_price")).alias("total"),
        )
    )
    # One row per month here, whatever the size of orders.
    before = F.lag("total").over(Window.orderBy("month"))
    return (
        monthly.withColumn("change", F.col("total") - before)
        .select("month", "order_count", "units",
                F.col("total").cast("double").alias("revenue"),
                F.col("change").cast("double").alias("revenue_change"))
        .orderBy(asc("month"))
    )


def user_spend(orders: DataFrame) -> DataFrame:
    """Items and spend per user."""
    return (
        orders.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.count("*").alias("units"), F.sum(_money("sale_price")).alias("total"))
        .select("user_id", "units", F.col("total").cast("double").alias("spend"))
    )


def _spend_cuts(spend: DataFrame, segments: int, accuracy: int) -> DataFrame:
    """One row with the array of exact cut points: the values at ranks ``ceil(n * i / segments)``.

    A quantile sketch brackets every cut first. What lies below a bracket only has to be counted,
    so just the distinct values inside it, a few ten-thousandths of all, are put in order.
    """
    numbers = list(range(1, segments))
    margin = 3 / accuracy
    shares = [max(i / segments - margin, 0.0) for i in numbers]
    shares += [min(i / segments + margin, 1.0) for i in numbers]
    sketch = spend.agg(F.struct(
        F.percentile_approx("spend", shares, accuracy).alias("bounds"), F.count("spend").alias("n")
    )).scalar()
    cut = F.posexplode(F.slice("sketch.bounds", 1, len(numbers))).alias("cut", "low")
    high = F.get("sketch.bounds", F.col("cut") + len(numbers))
    below = F.lit(float("-inf"))
    counted = (
        spend.where(F.col("spend").isNotNull())
        .select("spend", sketch.alias("sketch"))
        .select("spend", "sketch", cut)
        .where(F.col("spend") <= high)
        .groupBy("cut", F.when(F.col("spend") < F.col("low"), below)
                 .otherwise(F.col("spend")).alias("value"))
        .agg(F.count("*").alias("users"), F.any_value("sketch.n").alias("n"))
    )
    missed = (F.size("cuts") > 0) & ((F.size("cuts") != len(numbers)) | F.array_contains("cuts", below))
    reached = F.sum("users").over(Window.partitionBy("cut").orderBy("value"))
    rank = F.ceil((F.col("cut") + 1) * F.col("n") / segments)
    return (
        counted.withColumn("reached", reached)
        .where(F.col("reached") >= rank)
        .groupBy("cut").agg(F.min("value").alias("value"))
        .agg(F.array_sort(F.collect_list(F.struct("cut", "value"))).alias("cuts"))
        .select(F.col("cuts.value").alias("cuts"))
        .select(F.when(missed, F.raise_error(F.lit("a quantile bracket missed its cut"))).otherwise(F.col("cuts")).alias("cuts"))
    )


def user_segments(orders: DataFrame, segments: int = 4, accuracy: int = 10_000) -> DataFrame:
    """Users by spend, in ``segments`` groups of about equal size, 1 the lowest.

    No global sort or rank is taken; ``accuracy`` only decides how many values are looked at again.
    A user at a cut point belongs below it, and a user without a price belongs to no segment.
    Spend per user is used three times but worked out once: the filter, which every user passes, keeps ``units`` in all three, so that
    their exchanges are one.
    """
    spend = user_spend(orders).where("units > 0")
    cuts = _spend_cuts(spend, segments, accuracy).scalar()
    above = F.size(F.filter(F.col("cuts"), lambda cut: cut < F.col("spend")))
    segment = F.when(F.col("spend").isNotNull(), above + 1).cast("bigint")
    return spend.withColumn("cuts", cuts).select("user_id", "units", "spend", segment.alias("segment"))


def last_days(orders: DataFrame, days: int = 60, as_of: Instant | None = None) -> DataFrame:
    """Order items of the last ``days`` days, counted back from ``as_of``, or else from the newest item; never from today."""
    newest = orders.agg(F.max("created_at")).scalar() if as_of is None else instant(as_of)
    orders = orders_at(orders, as_of)
    return orders.where(F.col("created_at") > newest - F.make_dt_interval(days=F.lit(days)))


def unit_anomalies(orders: DataFrame, z: float = 2.0) -> DataFrame:
    """Product-months whose units lie at least ``z`` sample deviations from the product's mean.

    Months without a sale are not counted. A window holds one product's months: monthly counts
    have merged a popular product's items before it is formed.
    """
    product = Window.partitionBy("product_id")
    mean, deviation = F.avg("units").over(product), F.stddev_samp("units").over(product)
    return (
        monthly_counts(orders)
        .withColumns({"mean": mean, "deviation": deviation})
        .where(F.col("deviation") > 0)
        .withColumn("z_score", F.round((F.col("units") - F.col("mean")) / F.col("deviation"), 6))
        .where(F.abs("z_score") >= z)
        .select("month", "product_id", "units", "z_score")
        .orderBy(desc("z_score"), asc("month"), asc("product_id"))
    )


def retention(orders: DataFrame) -> DataFrame:
    """Users by month of first purchase, and how many of them bought again n months later."""
    active = (
        orders.where(F.col("user_id").isNotNull() & F.col("created_at").isNotNull())
        .groupBy("user_id").agg(F.collect_set(month_start(F.col("created_at"))).alias("months"))
    )
    # At most one entry per month in a user's set.
    cohorts = active.select("user_id", F.array_min("months").alias("cohort"), F.explode("months").alias("month"))
    offset = month_number(F.col("month")) - month_number(F.col("cohort"))
    return (
        cohorts.groupBy("cohort", offset.cast("bigint").alias("months_later"))
        .agg(F.count("*").alias("users"))
        .orderBy(asc("cohort"), asc("months_later"))
    )


def _check(name: str, table: str, column: str, failed: Column, total: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"),
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.coalesce(failed, F.lit(0)).cast("bigint").alias("failed"),
        F.coalesce(total, F.lit(0)).cast("bigint").alias("checked"),
    )


def row_checks(name: str, df: DataFrame, in_order: list[tuple[str, str]] = ()) -> DataFrame:
    """Nulls per column, and per ``(earlier, later)`` pair the rows where ``later`` lies before
    ``earlier``, of the rows that have both. One pass, however many checks."""
    def entry(check: str, column: str, failed: str, checked: str) -> str:
        return (
            f"named_struct('check_name', '{check}', 'table_name', '{name}', "
            f"'column_name', '{column}', 'failed', count_if({failed}), 'checked', {checked})"
        )

    entries = [entry("null", c, f"`{c}` IS NULL", "count(*)") for c in df.columns]
    entries += [
        entry(f"before_{earlier}", later, f"`{later}` < `{earlier}`",
              f"count_if(`{later}` IS NOT NULL AND `{earlier}` IS NOT NULL)")
        for earlier, later in in_order
    ]
    checks = F.expr(f"array({', '.join(entries)})")
    return df.agg(checks.alias("checks")).select(F.inline("checks"))


def duplicate_check(name: str, df: DataFrame, key: list[str]) -> DataFrame:
    """Rows beyond the first of each key; rows with a null in the key are not checked."""
    keyed = df.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("rows"))
    surplus = F.sum(F.col("rows") - 1)
    check = _check("duplicate_key", name, ",".join(key), surplus, F.sum("rows"))
    return keyed.agg(check.alias("c")).select("c.*")


def orphan_check(name: str, df: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Rows whose key does not occur in ``parent``.

    Both sides are grouped by the key before they meet, so a key that many rows share is one row
    of the join.
    """
    children = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    known = parent.select(column).distinct().withColumn("known", F.lit(True))
    joined = children.join(known, column, "left")
    orphans = F.sum(F.when(F.col("known").isNull(), F.col("rows")))
    check = _check("orphan_key", name, column, orphans, F.sum("rows"))
    return joined.agg(check.alias("c")).select("c.*")


def dq_checks(
    orders: DataFrame, inventory: DataFrame, mg: DataFrame,
    order_keys: DataFrame | None = None, inventory_keys: DataFrame | None = None,
) -> DataFrame:
    """All checks over the three tables: ``check_name, table_name, column_name, failed, checked``.

    Where the tables are joins, ``order_keys`` and ``inventory_keys`` may be cheaper tables with the same rows and key columns.
    """
    keys = orders if order_keys is None else order_keys
    units = inventory if inventory_keys is None else inventory_keys
    parts = [
        row_checks("orders", orders, [("created_at", "shipped_at")]),
        row_checks("inventory", inventory, [("created_at", "sold_at")]),
        row_checks("mg", mg),
        duplicate_check("orders", keys, ["order_id", "inventory_item_id"]),
        duplicate_check("mg", mg, ["month", "id_user"]),
        orphan_check("orders", keys, "product_id", units),
    ]
    return reduce(DataFrame.unionByName, parts)
