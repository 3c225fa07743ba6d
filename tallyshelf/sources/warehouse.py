"""Star-schema Parquet (order headers, order lines, parts, events) as the declared tables.

Two foreign keys are part of this mapping: every order line has one header, and every line's part
is one row of ``part``. They let a report read lines alone, or attach header and part columns to
the few rows it keeps, and still equal the report over the joined table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions.ordering import BROADCAST_ROWS
from tallyshelf.schemas import INVENTORY, MG, ORDERS
from tallyshelf.sources.conform import enforce_schema


# The columns used, so that no job has to open files to find a schema.
SOURCE_COLUMNS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_extendedprice double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, "
            "p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "documents": "doc_id bigint, text string, lang string, source string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the warehouse."""
    return spark.read.schema(SOURCE_COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The order columns that a line carries itself: no join."""
    return source(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_partkey AS product_id",
        "l_orderkey * 10 + l_linenumber AS inventory_item_id",
        "l_shipdate AS shipped_at",
        "CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS delivered_at",
        "CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS returned_at",
        "l_extendedprice AS sale_price",
    )


def order_headers(spark: SparkSession, folder: str) -> DataFrame:
    return source(spark, folder, "orders").selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS user_id",
        "o_orderstatus AS status",
        "o_orderdate AS created_at",
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sold item, in the declared ``orders`` schema."""
    lines = order_lines(spark, folder)
    return enforce_schema(lines.join(order_headers(spark, folder), "order_id"), ORDERS)


def attach_headers(top: DataFrame, n: int, spark: SparkSession, folder: str) -> DataFrame:
    """Header columns for a top-k of ``n`` lines.

    When ``n`` is small enough the lines are broadcast and the headers scanned in place, not
    shuffled.
    """
    kept = F.broadcast(top) if n <= BROADCAST_ROWS else top
    return enforce_schema(order_headers(spark, folder).join(kept, "order_id"), ORDERS)


def inventory_units(spark: SparkSession, folder: str) -> DataFrame:
    """The inventory columns that a unit carries itself: no join."""
    return source(spark, folder, "lineitem").selectExpr(
        "l_partkey AS product_id",
        "l_shipdate - INTERVAL '30' DAY AS created_at",
        "CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS sold_at",
        "l_suppkey AS product_distribution_center_id",
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    """One row per product with its attributes."""
    return source(spark, folder, "part").selectExpr(
        "p_partkey AS product_id",
        "p_retailprice / 2 AS cost",
        "p_type AS product_category",
        "p_name AS product_name",
        "p_brand AS product_brand",
        "p_retailprice AS product_retail_price",
        "concat('SKU-', p_partkey) AS product_sku",
    )


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """One row per unit, in the declared ``inventory`` schema."""
    units = inventory_units(spark, folder)
    return enforce_schema(units.join(products(spark, folder), "product_id"), INVENTORY)


def mg(spark: SparkSession, folder: str) -> DataFrame:
    """One row per worker and month, in the declared ``mg`` schema.

    Events are aggregated before customers are joined, so the joins run on worker-months.
    """
    activity = (
        source(spark, folder, "events")
        .selectExpr("date_format(ts, 'yyyy-MM') AS month", "user_id AS id_user",
                    "CAST(ts AS DATE) AS day", "event_type")
        .groupBy("month", "id_user")
        .agg(
            F.count_distinct("day").alias("attendance"),
            F.expr("count_if(event_type = 'purchase')").alias("total_delivered_month"),
            F.expr("count_if(event_type = 'error')").alias("errors"),
        )
    )
    people = source(spark, folder, "customer").selectExpr(
        "c_custkey AS id_user", "c_name AS name", "c_mktsegment AS fleet",
        "c_nationkey AS n_nationkey",
    )
    table = (
        activity.join(people, "id_user")
        .join(source(spark, folder, "nation"), "n_nationkey")
        .selectExpr(
            "*",
            "n_name AS city",
            "CASE WHEN id_user % 10 <> 0 THEN concat('VENDOR_', n_nationkey % 5) END"
            " AS vendor_name",
            "10.0D AS rate",
            "CASE WHEN attendance >= 28 THEN 1L ELSE 0L END AS perfect_attendance",
            "200.0D AS monthly_mg",
            "total_delivered_month * 10.0D AS payout",
            "errors * 2.0D AS fnd_ndr_penalty_amount",
        )
        .selectExpr(
            "*",
            "perfect_attendance AS mg_eligible",
            "monthly_mg * perfect_attendance AS eligible_mg",
            "CASE WHEN id_user % 7 <> 0 THEN payout - fnd_ndr_penalty_amount END AS total_payout",
        )
        .withColumn("da_level_final_amount", F.col("total_payout"))
    )
    return enforce_schema(table, MG)


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three declared tables by name."""
    return {
        "orders": orders(spark, folder),
        "inventory": inventory(spark, folder),
        "mg": mg(spark, folder),
    }
