"""Stock over time: each unit is received once and sold at most once; running sums of these events give the stock at any month's end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.calendar import month_start
from tallyshelf.functions.ordering import asc, desc
from tallyshelf.operators.stock import ATTRIBUTES


def _events(inventory: DataFrame) -> DataFrame:
    """``product_id, month, received, sold``: up to two rows per unit, at the months of its events."""

    def event(time: str, received: int, sold: int) -> Column:
        return F.struct(
            month_start(F.col(time)).alias("month"),
            F.lit(received).alias("received"), F.lit(sold).alias("sold"),
        )

    known = inventory.where("product_id IS NOT NULL AND created_at IS NOT NULL")
    events = known.select("product_id", F.inline(F.array(event("created_at", 1, 0), event("sold_at", 0, 1))))
    return events.where("month IS NOT NULL")


def _running(column: Column) -> Column:
    so_far = Window.partitionBy("product_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(column).over(so_far)


def monthly_stock(inventory: DataFrame) -> DataFrame:
    """``product_id, month, received, sold, on_hand``: per month in which something happened, ``on_hand`` at its end.

    Units without a product or a date of receipt are left out. Events are summed per product and month
    before the running sums, so a product is as many rows as it has months, however many units.
    """
    months = _events(inventory).groupBy("product_id", "month").agg(
        F.sum("received").alias("received"), F.sum("sold").alias("sold"))
    return months.withColumn("on_hand", _running(F.col("received") - F.col("sold")))


def monthly_units_then(
    orders: DataFrame, inventory: DataFrame, products: DataFrame | None = None
) -> DataFrame:
    """Units sold per month and product, with the stock at the end of that month (not today's) and attributes.

    Sales and stock events are one union, grouped once: the stock of a month without events is the sum of the months before.
    """
    sold = orders.where("created_at IS NOT NULL AND product_id IS NOT NULL").select(
        "product_id", month_start(F.col("created_at")).alias("month"), F.lit(1).alias("units"), F.lit(0).alias("change"))
    moved = _events(inventory).select("product_id", "month", F.lit(0).alias("units"), (F.col("received") - F.col("sold")).alias("change"))
    months = sold.union(moved).groupBy("product_id", "month").agg(
        F.sum("units").alias("units_sold"), F.sum("change").alias("change"))
    months = months.withColumn("on_hand", _running(F.col("change"))).where("units_sold > 0")
    known = (inventory if products is None else products).where("product_id IS NOT NULL")
    attributes = known.select("product_id", *ATTRIBUTES).distinct().groupBy("product_id").agg(
        *[F.max(c).alias(c) for c in ATTRIBUTES])
    return (
        months.join(attributes, "product_id", "left")
        .select(F.col("month").alias("year_month"), "product_id", *ATTRIBUTES, "units_sold", "on_hand")
        .orderBy(desc("year_month"), desc("units_sold"), asc("product_id"))
    )
