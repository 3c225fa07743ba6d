"""Stock reports: units sold and units on hand per product.

``inventory`` holds one row per physical unit, on hand while ``sold_at`` is null. Product
attributes come either from the unit rows themselves (the flat form) or, with ``products``, from a
table of attributes per product (the star form); both give the same report.

With ``as_of`` a report is the one of that instant: items and units created later are left out, and units
sold later are on hand. Both tables then need their ``created_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.as_of import Instant, inventory_at, orders_at
from tallyshelf.functions.ordering import BROADCAST_ROWS, asc, desc, take
from tallyshelf.operators.sales import monthly_counts

ATTRIBUTES = ["product_name", "product_brand", "product_category"]
REPORT_COLUMNS = ["product_id", *ATTRIBUTES, "units_sold", "on_hand"]

# The reports' default limits and bounds.
TOP_SOLD_ROWS = 5
REPORT_ROWS = 100
LOW_STOCK = 10
SLOW_UNITS = 1


def _maxima() -> list[Column]:
    return [F.expr(f"max({a}) AS {a}") for a in ATTRIBUTES]


def _sums() -> list[Column]:
    sums = {"units_sold": "sold", "on_hand": "held", "stocked": "stocked"}
    return [F.expr(f"sum({part}) AS {name}") for name, part in sums.items()]


def _movements(orders: DataFrame, inventory: DataFrame, attributes: list[str]) -> DataFrame:
    """Order items and inventory units as one stream of per-product increments.

    Grouping this union gives what a full outer join of two grouped tables would, with one
    map-side aggregate and one exchange. ``stocked`` counts inventory rows.
    """
    no_attributes = [f"CAST(NULL AS STRING) AS {a}" for a in attributes]
    sold = orders.where("product_id IS NOT NULL").selectExpr(
        "product_id", *no_attributes, "1 AS sold", "0 AS held", "0 AS stocked"
    )
    held = "CASE WHEN sold_at IS NULL THEN 1 ELSE 0 END AS held"
    units = inventory.where("product_id IS NOT NULL").selectExpr(
        "product_id", *attributes, "0 AS sold", held, "1 AS stocked"
    )
    return sold.union(units)


def stock_counts(orders: DataFrame, inventory: DataFrame) -> DataFrame:
    """``product_id, units_sold, on_hand, stocked`` for every product in either table."""
    return _movements(orders, inventory, []).groupBy("product_id").agg(*_sums())


def _flat_position(orders: DataFrame, inventory: DataFrame) -> DataFrame:
    """Counts and attributes in one pass over each table.

    Attributes are grouping keys first: that keeps the pass over all rows a hash aggregate, and
    leaves about one row per product for the maximum over text, which Spark can only sort.
    """
    per_text = (
        _movements(orders, inventory, ATTRIBUTES).groupBy("product_id", *ATTRIBUTES).agg(*_sums())
    )
    return per_text.groupBy("product_id").agg(
        F.expr("sum(units_sold) AS units_sold"), F.expr("sum(on_hand) AS on_hand"), *_maxima()
    )


# Attributes describe inventory: a product without a unit there has none.
_STOCKED_REPORT = [
    f"CASE WHEN stocked > 0 THEN {c} END AS {c}" if c in ATTRIBUTES else c for c in REPORT_COLUMNS
]


def _attach(top: DataFrame, products: DataFrame, n: int) -> DataFrame:
    """Attributes for the rows of a top-k of ``n`` rows.

    When ``n`` is small enough the top-k is broadcast into a scan of ``products``; the counts behind
    it are computed once, both uses read the same exchange. A larger one is joined.
    """
    if n > BROADCAST_ROWS:
        attributes = products.groupBy("product_id").agg(*_maxima())
        return top.join(attributes, "product_id", "left")
    found = (
        products.join(F.broadcast(top), "product_id")
        .groupBy(*top.columns)
        .agg(*_maxima())
        .select("product_id", *ATTRIBUTES)
    )
    return top.join(F.broadcast(found), "product_id", "left")


def stock_position(
    orders: DataFrame, inventory: DataFrame, products: DataFrame | None = None,
    as_of: Instant | None = None,
) -> DataFrame:
    """One row per product seen in orders or inventory: units sold, units on hand, attributes."""
    orders, inventory = orders_at(orders, as_of), inventory_at(inventory, as_of)
    if products is None:
        return _flat_position(orders, inventory).select(*REPORT_COLUMNS)
    attributes = products.groupBy("product_id").agg(*_maxima())
    counts = stock_counts(orders, inventory)
    return counts.join(attributes, "product_id", "left").selectExpr(*_STOCKED_REPORT)


def _report(
    orders: DataFrame,
    inventory: DataFrame,
    products: DataFrame | None,
    where: str | None,
    keys: list[Column],
    n: int,
    as_of: Instant | None,
) -> DataFrame:
    keys = [*keys, asc("product_id")]
    orders, inventory = orders_at(orders, as_of), inventory_at(inventory, as_of)
    if products is None:
        position = _flat_position(orders, inventory)
        chosen = position if where is None else position.where(where)
        return take(chosen.select(*REPORT_COLUMNS), keys, n)
    counts = stock_counts(orders, inventory)
    top = take(counts if where is None else counts.where(where), keys, n)
    return _attach(top, products, n).selectExpr(*_STOCKED_REPORT).orderBy(*keys)


def top_sold(
    orders: DataFrame, inventory: DataFrame, n: int = TOP_SOLD_ROWS,
    products: DataFrame | None = None, as_of: Instant | None = None,
) -> DataFrame:
    """The ``n`` products with most units sold."""
    return _report(orders, inventory, products, None, [desc("units_sold")], n, as_of)


def reorder(
    orders: DataFrame, inventory: DataFrame, threshold: int = LOW_STOCK,
    products: DataFrame | None = None, n: int = REPORT_ROWS, as_of: Instant | None = None,
) -> DataFrame:
    """Products with fewer than ``threshold`` units on hand, emptiest first."""
    low = f"on_hand < {int(threshold)}"
    keys = [asc("on_hand"), desc("units_sold")]
    return _report(orders, inventory, products, low, keys, n, as_of)


def slow_movers(
    orders: DataFrame, inventory: DataFrame, threshold: int = LOW_STOCK,
    max_units: int = SLOW_UNITS, products: DataFrame | None = None, n: int = REPORT_ROWS,
    as_of: Instant | None = None,
) -> DataFrame:
    """Products with at least ``threshold`` on hand and at most ``max_units`` sold."""
    slow = f"on_hand >= {int(threshold)} AND units_sold <= {int(max_units)}"
    return _report(orders, inventory, products, slow, [desc("on_hand")], n, as_of)


def stock_overview(
    orders: DataFrame, inventory: DataFrame, products: DataFrame | None = None,
    n: int = REPORT_ROWS, as_of: Instant | None = None,
) -> DataFrame:
    """Best sellers first, scarcest first among equals."""
    keys = [desc("units_sold"), asc("on_hand")]
    return _report(orders, inventory, products, None, keys, n, as_of)


def stock_on_hand(inventory: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """``product_id, on_hand`` and attributes for every product in inventory."""
    known = inventory.where("product_id IS NOT NULL")
    held = F.expr("count_if(sold_at IS NULL) AS on_hand")
    if products is None:
        per_text = known.groupBy("product_id", *ATTRIBUTES).agg(held)
        return per_text.groupBy("product_id").agg(F.expr("sum(on_hand) AS on_hand"), *_maxima())
    attributes = products.groupBy("product_id").agg(*_maxima())
    return known.groupBy("product_id").agg(held).join(attributes, "product_id", "left")


def monthly_units_stock(
    orders: DataFrame, inventory: DataFrame, products: DataFrame | None = None,
    as_of: Instant | None = None,
) -> DataFrame:
    """Units sold per month and product, with the product's current stock and attributes."""
    orders, inventory = orders_at(orders, as_of), inventory_at(inventory, as_of)
    return (
        monthly_counts(orders)
        .join(stock_on_hand(inventory, products), "product_id", "left")
        .selectExpr("month AS year_month", "product_id", *ATTRIBUTES, "units AS units_sold",
                    "coalesce(on_hand, 0) AS on_hand")
        .orderBy(desc("year_month"), desc("units_sold"), asc("product_id"))
    )
