"""Inputs that no given table holds, derived from the given tables by Spark: CSV exports with the
usual faults, and logs of questions, replies and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.schemas import MG, ORDERS
from tallyshelf.sources import warehouse
from tallyshelf.sources.scratch import fresh_path, stored

ISO = "yyyy-MM-dd HH:mm:ss"

# A separator and quote that no value contains: each row is written as one ready-made line.
_WHOLE_LINE = {"sep": "\u0001", "quote": "\u0000", "escape": "\u0000"}
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False}


def _as_text(df: DataFrame) -> DataFrame:
    """Every column as text, timestamps to the second."""
    return df.select(*[
        (F.date_format(f.name, ISO) if f.dataType.simpleString() == "timestamp_ntz"
         else F.col(f.name).cast("string")).alias(f.name)
        for f in df.schema.fields
    ])


def _export(df: DataFrame, label: str, **options: object) -> str:
    path = fresh_path(df.sparkSession, label)
    df.write.options(**{**_CSV, **options}).csv(path)
    return path


def orders_csv(spark: SparkSession, folder: str) -> str:
    """Order items under untidy headers, with the price and user columns under aliases."""
    text = _as_text(warehouse.orders(spark, folder))
    renamed = {"id": " ID ", "user_id": "Customer_ID", "sale_price": "Price"}
    return _export(text.withColumnsRenamed(renamed), "orders")


def inventory_csv(spark: SparkSession, folder: str) -> str:
    """Units with every value quoted, cost under an alias."""
    text = _as_text(warehouse.inventory(spark, folder))
    return _export(text.withColumnsRenamed({"cost": "Unit_Cost"}), "inventory", quoteAll=True)


def documents_latin1_csv(spark: SparkSession, folder: str) -> str:
    """Documents as product names, whole, in ISO-8859-1; texts hold line breaks and quotes."""
    documents = warehouse.source(spark, folder, "documents").select(
        F.col("doc_id").alias("product_id"), F.col("text").alias("product_name"),
        F.col("source").alias("product_brand"), F.col("lang").alias("product_category"),
    )
    return _export(documents, "latin1", encoding="ISO-8859-1")


def mg_csv(spark: SparkSession, folder: str) -> str:
    """Worker-months under spaced headers."""
    text = _as_text(warehouse.mg(spark, folder))
    headers = {c: c.replace("_", " ").title() for c in MG.columns}
    headers["vendor_name"] = "Vendor"
    return _export(text.withColumnsRenamed(headers), "mg")


def uneven_csv(spark: SparkSession, folder: str) -> str:
    """Order lines of which every fifth order's have a field too many, and every seventh's end
    after the product."""
    columns = ["order_id", "product_id", "inventory_item_id", "shipped_at", "sale_price"]
    line = _as_text(warehouse.order_lines(spark, folder).select(*columns))
    order = F.col("order_id").cast("bigint")
    full = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in columns])
    row = (
        F.when(order % 5 == 0, F.concat(full, F.lit(",surplus")))
        .when(order % 7 == 0, F.concat_ws(",", "order_id", "product_id"))
        .otherwise(full)
    )
    return _export(line.select(row.alias(",".join(columns))), "uneven", **_WHOLE_LINE)


def aliased_csv(spark: SparkSession, folder: str) -> str:
    """Orders whose user is under one of two aliases, and missing as a word under the other."""
    headers = warehouse.order_headers(spark, folder)
    even = F.col("user_id") % 2 == 0
    user = F.col("user_id").cast("string")
    return _export(
        _as_text(headers).select(
            "order_id",
            F.when(even, user).otherwise("NA").alias("buyer_id"),
            F.when(even, "null").otherwise(user).alias("customer_id"),
            "created_at",
        ),
        "aliased",
    )


def messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order items as text, with values that do not fit their column's type."""
    items = warehouse.orders(spark, folder)
    order, product, item = F.col("order_id"), F.col("product_id"), F.col("inventory_item_id")
    created, user = F.col("created_at"), F.col("user_id")
    return items.select(
        F.when(item % 41 == 0, "item").otherwise(F.concat(F.lit(" "), item.cast("string"), F.lit(" "))).alias("id"),
        F.when(order % 11 == 0, F.concat(order.cast("string"), F.lit(".5")))
        .when(order % 7 == 0, F.concat(order.cast("string"), F.lit(".0")))
        .otherwise(order.cast("string")).alias("order_id"),
        F.when(user % 43 == 0, F.concat(F.lit("+"), user.cast("string"))).otherwise(user.cast("string")).alias("user_id"),
        F.when(product % 47 == 0, F.concat(product.cast("string"), F.lit("e0"))).otherwise(product.cast("string")).alias("product_id"),
        F.concat(item.cast("string"), F.when(item % 31 == 0, F.lit(".50")).otherwise(".00")).alias("inventory_item_id"),
        F.when(product % 29 == 0, "NA").otherwise(F.col("status")).alias("status"),
        F.when(order % 5 == 0, F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'+05:30'"))
        .when(order % 19 == 0, F.date_format(created, "dd/MM/yyyy"))
        .when(order % 23 == 0, "soon")
        .otherwise(F.date_format(created, ISO)).alias("created_at"),
        F.when(product % 7 == 0, "later").when(product % 3 == 0, F.date_format("shipped_at", "yyyy/M/d H:mm:ss"))
        .otherwise(F.date_format("shipped_at", ISO)).alias("shipped_at"),
        F.when(product % 5 == 0, F.date_format("delivered_at", "MMM d, yyyy"))
        .otherwise(F.date_format("delivered_at", ISO)).alias("delivered_at"),
        F.date_format("returned_at", "yyyy-MM-dd HH:mm:ss'+0200'").alias("returned_at"),
        F.when(product % 13 == 0, "n/a")
        .when(product % 17 == 0, "x")
        .otherwise(F.col("sale_price").cast("string")).alias("sale_price"),
    )


def partial_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order items without some declared columns and with one that is not declared."""
    items = warehouse.orders(spark, folder)
    return items.select(
        F.lit("x").alias("note"),
        *[c for c in reversed(ORDERS.columns) if c not in ("returned_at", "inventory_item_id")],
    )


def orders_with_nan(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines whose price is NaN for every seventh product."""
    lines = warehouse.order_lines(spark, folder)
    price = F.when(F.col("product_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("sale_price"))
    return lines.withColumn("sale_price", price)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """``question_id, question``: one per event by its type, and every user turn of a conversation."""
    events = warehouse.source(spark, folder, "events")
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    asked = (
        F.when(kind == "click",
               F.concat(F.lit("Show me top "), user, F.lit(" most sold items in inventory")))
        .when(kind == "view", F.concat(F.lit("inventory items to reorder below "), user))
        .when(kind == "purchase", F.concat(F.lit("top "), user, F.lit(" orders by highest value")))
        .when(kind == "signup", F.lit("minimum guarantee by city"))
        .otherwise(F.lit("monthly inventory units"))
    )
    turns = warehouse.source(spark, folder, "conversations").where(F.col("role") == "user")
    spoken = turns.select(
        (-1 - (F.col("conv_id") * 1000 + F.col("turn"))).alias("question_id"),
        F.col("text").alias("question"),
    )
    return events.select(F.col("event_id").alias("question_id"), asked.alias("question")).unionByName(
        spoken
    )


def _pick(key: Column, names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), (key % len(names)).cast("int"))


def sql_replies(spark: SparkSession, folder: str) -> DataFrame:
    """``reply_id, reply``: fenced queries with lead-ins, comments and a second statement."""
    events = warehouse.source(spark, folder, "events")
    event, user = F.col("event_id"), F.col("user_id").cast("string")
    fenced = F.concat(
        F.lit("Here is the SQL:\n```sql\nselect * FROM orders WHERE user_id = "), user,
        F.lit(" -- newest; first\nORDER BY created_at DESC;\nDROP TABLE orders;\n```"),
    )
    with_clause = F.concat(
        F.lit("Query: the one with most rows is\nWITH t AS (SELECT user_id FROM orders "),
        F.lit("/* all;\nof them */ WHERE user_id = "), user, F.lit(") SELECT * FROM t; SELECT 1"),
    )
    none = F.concat(F.lit("No answer for user "), user, F.lit("; ask again."))
    reply = F.when(event % 7 == 0, none).when(event % 5 == 0, with_clause).otherwise(fenced)
    return events.select(event.alias("reply_id"), reply.alias("reply"))


# Names of the logged queries' columns: some are in the schema, some are not.
ORDER_NAMES = ["order_id", "customer", "sale_price", "amount", "Sale_Prise", "created", "statuses"]
INVENTORY_NAMES = ["cost", "pid", "product_brand", "brand", "unit_cost", "produkt_name"]
MG_NAMES = ["vendor", "payout", "total_payut", "penalty", "city"]


def sql_log(spark: SparkSession, folder: str) -> DataFrame:
    """``query_id, sql``: a join of orders and inventory; every third query reads mg, every fourth
    a CTE whose alias is the letter that otherwise stands for mg."""
    events = warehouse.source(spark, folder, "events")
    key = F.col("event_id")
    joined = F.concat(
        F.lit("SELECT o."), _pick(key, ORDER_NAMES), F.lit(", i."), _pick(key, INVENTORY_NAMES),
        F.lit(" FROM orders o JOIN inventory AS i ON o.product_id = i.product_id WHERE o."),
        _pick(key + 3, ORDER_NAMES), F.lit(" > 1.5"),
    )
    payouts = F.concat(F.lit("SELECT m."), _pick(key, MG_NAMES), F.lit(" FROM mg m"))
    cte = F.concat(
        F.lit("WITH monthly AS (SELECT orders."), _pick(key, ORDER_NAMES),
        F.lit(" AS x FROM orders WHERE user_id > 0) SELECT m.x, m.year_month FROM monthly m"),
    )
    sql = F.when(key % 4 == 0, cte).when(key % 3 == 0, payouts).otherwise(joined)
    return events.select(key.alias("query_id"), sql.alias("sql"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    ).parquet(f"{folder}/events.parquet")


def promotions(spark: SparkSession, folder: str) -> DataFrame:
    """``product_id, promo_start, promo_end``: two periods per product, as long as its size says in weeks and in days."""
    parts = spark.read.schema("p_partkey bigint, p_size int").parquet(f"{folder}/part.parquet")
    first = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    days = lambda n: F.make_dt_interval(days=n)
    early = first + days((F.col("p_partkey") % 1800).cast("int"))
    late = first + days((F.col("p_partkey") * 7 % 2400).cast("int"))
    periods = F.array(
        F.struct(early.alias("promo_start"), (early + days(F.col("p_size") * 7)).alias("promo_end")),
        F.struct(late.alias("promo_start"), (late + days(F.col("p_size"))).alias("promo_end")),
    )
    return parts.select(F.col("p_partkey").alias("product_id"), F.inline(periods))


ARRIVING = "order_id bigint, product_id bigint, created_at timestamp_ntz"
LATE_EVERY, LATE_BEFORE = 50, 1998


def arriving_orders(spark: SparkSession, folder: str) -> str:
    """A folder to which order items were added year by year; some of the years before 1998 came last."""
    items = stored(warehouse.orders(spark, folder).select("order_id", "product_id", "created_at"), "arriving")
    year = F.year("created_at")
    late = (year < LATE_BEFORE) & (F.col("order_id") % LATE_EVERY == 0)
    path = fresh_path(spark, "arrivals")
    years = [r[0] for r in items.select(year).distinct().orderBy(year).collect() if r[0] is not None]
    # One file is one batch of the stream. Its one task only writes: joins and filters run in many.
    for arrived in [*((year == y) & ~late for y in years), late]:
        items.where(arrived).repartition(1).write.mode("append").parquet(path)
    return path


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """``event_id, payload``: an event as JSON text; some break off, some spell the user as a word, some have a field more, some are null."""
    seen = events(spark, folder)
    event, user = F.col("event_id"), F.col("user_id").cast("string")
    quote = lambda column: F.concat(F.lit('"'), column, F.lit('"'))
    text = F.concat(
        F.lit('{"user": '), F.when(event % 11 == 0, quote(F.concat(F.lit("u"), user))).otherwise(user),
        F.lit(', "kind": '), quote(F.col("event_type")), F.lit(', "value": '), F.col("value").cast("decimal(18,2)").cast("string"),
        F.lit(', "tags": ["a", "b"]'), F.when(event % 7 == 0, F.lit(', "note": "x"')).otherwise(""),
        F.when(event % 13 == 0, "").otherwise("}"))
    return seen.select("event_id", F.when(event % 17 != 0, text).alias("payload"))


def order_states(spark: SparkSession, folder: str) -> DataFrame:
    """``order_id, user_id, status, created_at, changed_at, placed``: orders with the year they were placed in."""
    headers = warehouse.order_headers(spark, folder)
    return headers.withColumns({"changed_at": F.col("created_at"), "placed": F.year("created_at")})


def order_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Later states of every tenth order: two for every twentieth, one that comes too late for every thirtieth, another year for every
    seventieth, each of them twice."""
    states, order = order_states(spark, folder).where("order_id % 10 = 0"), F.col("order_id")
    days = lambda n: F.col("created_at") + F.make_dt_interval(days=F.lit(n))
    changed = states.withColumns({
        "status": F.lit("R"), "changed_at": days(5), "placed": F.when(order % 70 == 0, F.col("placed") + 1).otherwise(F.col("placed"))})
    again = changed.where("order_id % 20 = 0").withColumns({"status": F.lit("C"), "changed_at": days(9)})
    stale = states.where("order_id % 30 = 0").withColumns({"status": F.lit("X"), "changed_at": days(-1)})
    every = changed.unionByName(again).unionByName(stale)
    return every.unionByName(every)
