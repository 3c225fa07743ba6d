"""One callable per registered query: (session, folder of the given tables) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.functions.ordering import desc, then_by_rest
from tallyshelf.operators import (
    analyses, columns, cubes, dominance, history, nested, payouts, profile, runs, sales, sessions, stock, textlog, time_joins,
)
from tallyshelf.plans.ask import ask, reply
from tallyshelf.plans.free_select import free_select, isolated_session, register
from tallyshelf.schemas import INVENTORY, MG, ORDERS
from tallyshelf.sinks import upsert
from tallyshelf.sources import conform, csv_tables, warehouse
from tallyshelf.sources.scratch import fresh_path, stored
from tallyshelf.streaming import monthly
from workload import inputs
from workload.free_sql import FREE_SQL

Query = Callable[[SparkSession, str], DataFrame]

# Every product has more than SLOW_UNITS items over all time in the given tables.
SLOW_MAX_UNITS = 25
SLOW_THRESHOLD = 12


def _star(report: Callable[..., DataFrame], **params: object) -> Query:
    """A stock report that needs no date: order lines, unit lines and the product table."""
    return lambda spark, folder: report(
        warehouse.order_lines(spark, folder),
        warehouse.inventory_units(spark, folder),
        products=warehouse.products(spark, folder),
        **params,
    )


def _orders(report: Callable[..., DataFrame], **params: object) -> Query:
    return lambda spark, folder: report(warehouse.orders(spark, folder), **params)


def _monthly_units_stock(spark: SparkSession, folder: str) -> DataFrame:
    return stock.monthly_units_stock(
        warehouse.orders(spark, folder),
        warehouse.inventory_units(spark, folder),
        warehouse.products(spark, folder),
    )


def _slow_movers_60d(spark: SparkSession, folder: str) -> DataFrame:
    return stock.slow_movers(
        analyses.last_days(warehouse.orders(spark, folder), 60),
        warehouse.inventory_units(spark, folder),
        products=warehouse.products(spark, folder),
    )


def _flat_position(spark: SparkSession, folder: str) -> DataFrame:
    return stock.stock_position(
        warehouse.orders(spark, folder), warehouse.inventory(spark, folder)
    )


def _orders_by_value(spark: SparkSession, folder: str) -> DataFrame:
    n = sales.BY_VALUE_ROWS
    top = sales.orders_by_value(warehouse.order_lines(spark, folder), n)
    return sales.orders_by_value(warehouse.attach_headers(top, n, spark, folder), n)


def _preview(spark: SparkSession, folder: str) -> DataFrame:
    listing = warehouse.orders(spark, folder)
    keys = [desc("created_at"), *then_by_rest(listing, ["created_at"])]
    return profile.preview(listing, keys, as_many=warehouse.order_lines(spark, folder))


def _payouts(spark: SparkSession, folder: str) -> DataFrame:
    return payouts.payouts(warehouse.mg(spark, folder))


def _free(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        session = register(warehouse.tables(isolated_session(spark), folder))
        text = FREE_SQL[name].format(orders="orders", inventory="inventory", mg="mg")
        return free_select(session, text)

    return run


def _asked(question: str) -> Query:
    return lambda spark, folder: ask(question, warehouse.tables(spark, folder))


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_manifest(warehouse.tables(spark, folder))


def _table_shapes(spark: SparkSession, folder: str) -> DataFrame:
    # By the foreign keys of the mapping, each line is one order item and one unit.
    lines = warehouse.order_lines(spark, folder)
    return profile.table_shapes(warehouse.tables(spark, folder), {"orders": lines, "inventory": lines})


def _load_orders(spark: SparkSession, folder: str) -> DataFrame:
    return csv_tables.load_table(spark, ORDERS, inputs.orders_csv(spark, folder)).table


def _load_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return csv_tables.load_table(spark, INVENTORY, inputs.inventory_csv(spark, folder)).table


def _load_documents(**options: object) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = inputs.documents_latin1_csv(spark, folder)
        return csv_tables.load_table(spark, INVENTORY, path, **options).table

    return run


def _load_skip_bad(spark: SparkSession, folder: str) -> DataFrame:
    return csv_tables.load_table(spark, ORDERS, inputs.uneven_csv(spark, folder)).table


def _load_mg(spark: SparkSession, folder: str) -> csv_tables.LoadedTable:
    path = inputs.mg_csv(spark, folder)
    candidates = [f"{path}/minimum_guarantee.csv", f"{path}/Minimum_Guarantee.csv", path]
    return csv_tables.load_table(spark, MG, candidates)


def _load_mg_missing(spark: SparkSession, folder: str) -> DataFrame:
    return _load_mg(spark, folder).table


def _load_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return csv_tables.load_table(spark, ORDERS, inputs.aliased_csv(spark, folder)).table


def _load_report(spark: SparkSession, folder: str) -> DataFrame:
    uneven = inputs.uneven_csv(spark, folder)
    latin1 = inputs.documents_latin1_csv(spark, folder)
    loads = [
        csv_tables.load_table(spark, ORDERS, uneven),
        csv_tables.load_table(spark, INVENTORY, latin1),
        _load_mg(spark, folder),
        csv_tables.load_table(spark, MG, [f"{uneven}/mg.csv"]),
    ]
    # Which files of a folder hold a letter beyond ASCII depends on how they were written.
    latin1 = F.coalesce(F.col("encoding").contains(csv_tables.LATIN1), F.lit(False))
    tried = F.size(F.filter(F.split("tried", ","), lambda path: path != "")).cast("bigint")
    return reduce(DataFrame.unionByName, [load.report() for load in loads]).select(
        "table_name", "missing", latin1.alias("latin1"), "multiline", "bad_rows", "cols",
        "row_count", "skipped_rows", tried.alias("tried_paths"),
    )


def _enforce_schema(spark: SparkSession, folder: str) -> DataFrame:
    return conform.enforce_schema(inputs.partial_orders(spark, folder), ORDERS)


def _coerce_types(spark: SparkSession, folder: str) -> DataFrame:
    return conform.coerce_types(inputs.messy_orders(spark, folder), ORDERS, ["dd/MM/yyyy"])


def _coercion_report(spark: SparkSession, folder: str) -> DataFrame:
    return conform.coercion_failures(inputs.messy_orders(spark, folder), ORDERS, ["dd/MM/yyyy"])


def _nan_to_null(spark: SparkSession, folder: str) -> DataFrame:
    return conform.nan_to_null(inputs.orders_with_nan(spark, folder))


def _route_questions(spark: SparkSession, folder: str) -> DataFrame:
    return textlog.route_questions(inputs.questions(spark, folder))


def _clean_sql_log(spark: SparkSession, folder: str) -> DataFrame:
    return textlog.clean_sql_log(inputs.sql_replies(spark, folder)).select("reply_id", "sql")


def _audit_columns(spark: SparkSession, folder: str) -> DataFrame:
    return columns.audit_columns(inputs.sql_log(spark, folder))


def _suggest(similarity: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        missing = columns.audit_columns(inputs.sql_log(spark, folder))
        samples = profile.column_samples(warehouse.tables(spark, folder))
        return columns.suggest_columns(missing, samples, similarity)

    return run


def _dq_checks(spark: SparkSession, folder: str) -> DataFrame:
    return analyses.dq_checks(
        **warehouse.tables(spark, folder), order_keys=warehouse.order_lines(spark, folder),
        inventory_keys=warehouse.inventory_units(spark, folder))


# An instant within the given order dates.
AS_OF = "1999-07-01 12:00:00"
SESSION_GAP = 7200


def _stock_as_of(report: Callable[..., DataFrame], **params: object) -> Query:
    return lambda spark, folder: report(
        warehouse.orders(spark, folder), warehouse.inventory_units(spark, folder),
        products=warehouse.products(spark, folder), as_of=AS_OF, **params,
    )


def _monthly_units_then(spark: SparkSession, folder: str) -> DataFrame:
    return history.monthly_units_then(
        warehouse.orders(spark, folder), warehouse.inventory_units(spark, folder), warehouse.products(spark, folder))


def _asof_last_event(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase with the user's latest other event up to then."""
    events = inputs.events(spark, folder)
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    others = events.where("event_type <> 'purchase'")
    taken = {"last_ts": "ts", "last_type": "event_type", "last_event_id": "event_id"}
    return time_joins.asof_join(bought, others, ["user_id"], "ts", "ts", taken)


def _asof_last_price(spark: SparkSession, folder: str) -> DataFrame:
    """Each sold item with the latest price of its product on an earlier day."""
    # The join reads its tables several times: lines meet their headers once.
    items = stored(warehouse.orders(spark, folder).select("inventory_item_id", "product_id", "created_at", "sale_price"), "priced")
    prices = items.select("product_id", "created_at", "sale_price")
    taken = {"price_before": "sale_price", "priced_at": "created_at"}
    return time_joins.asof_join(items, prices, ["product_id"], "created_at", "created_at", taken, 90 * 86_400, strict=True)


def _open_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per order how many items of the user's earlier orders were not shipped by then."""
    orders = warehouse.order_headers(spark, folder).select("order_id", "user_id", "created_at")
    items = warehouse.orders(spark, folder).select(
        "user_id", F.col("created_at").alias("opened_at"), "shipped_at")
    met = time_joins.points_in_intervals(orders, items, ["user_id"], "created_at", "opened_at", "shipped_at", strict=True)
    return met.groupBy("order_id").agg(F.count("*").alias("open_items"))


def _promoted_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items on their way during a promotion of their product."""
    items = warehouse.orders(spark, folder).select("inventory_item_id", "product_id", "created_at", "shipped_at")
    return time_joins.overlapping(
        items, inputs.promotions(spark, folder), ["product_id"], ("created_at", "shipped_at"), ("promo_start", "promo_end"))


def _better_products(spark: SparkSession, folder: str) -> DataFrame:
    """Per product how many others cost no more and sold no fewer, and differ in one of it."""
    sold = warehouse.order_lines(spark, folder).groupBy("product_id").agg(F.count("*").alias("units_sold"))
    products = warehouse.products(spark, folder).select("product_id", "product_retail_price")
    return dominance.beaten_by(products.join(sold, "product_id"), "product_retail_price", "units_sold")


def _user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.user_sessions(inputs.events(spark, folder), SESSION_GAP)


def _stream_monthly_units(spark: SparkSession, folder: str) -> DataFrame:
    """Orders arrive year by year, some of the first years' at the end; those are too late."""
    arrivals = inputs.arriving_orders(spark, folder)
    stream = spark.readStream.schema(inputs.ARRIVING).option("maxFilesPerTrigger", 1).parquet(arrivals)
    return monthly.run_monthly_units(stream, fresh_path(spark, "stream")).monthly


CUBE = ["year_of", "event_type", "evening"]


def _visits(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("ts")
    return inputs.events(spark, folder).select(
        "user_id", F.to_date(at).alias("day"), F.year(at).cast("bigint").alias("year_of"), "event_type", (F.hour(at) >= 18).alias("evening"))


def _user_cube(spark: SparkSession, folder: str) -> DataFrame:
    return cubes.exact_cube(_visits(spark, folder), CUBE)


def _sketched_user_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches per day merged to the cube, beside the exact numbers: whether each is within four per cent."""
    days = cubes.user_cells(_visits(spark, folder), ["day", *CUBE])
    exact = _user_cube(spark, folder).alias("e")
    sketched = cubes.cube_of_cells(days, CUBE).alias("s")
    same = reduce(Column.__and__, [F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*CUBE, "level"]])
    near = F.abs(F.col("s.users") - F.col("e.users")) <= F.ceil(F.col("e.users") * 0.04)
    return exact.join(sketched, same).select("e.level", *[f"e.{c}" for c in CUBE], "s.row_count", near.alias("near"))


def _conversation_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return nested.block_facts(nested.fold_turns(warehouse.source(spark, folder, "conversations")))


PAYLOAD = (
    T.StructType().add("user", T.LongType()).add("kind", T.StringType()).add("value", T.DoubleType())
    .add("tags", T.ArrayType(T.StringType())))


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    read = nested.read_payloads(inputs.payloads(spark, folder), "payload", PAYLOAD)
    tags = F.when(F.col("payload.tags").isNotNull(), F.array_join("payload.tags", "+"))
    return read.select("event_id", "payload.user", "payload.kind", "payload.value", tags.alias("tags"), "state", "raw")


def _payload_states(spark: SparkSession, folder: str) -> DataFrame:
    """Under a learned schema: the user is text there, and the field that some rows have more is known."""
    rows = inputs.payloads(spark, folder)
    return nested.payload_states(nested.read_payloads(rows, "payload", nested.learned_schema(rows, "payload")))


def _upserted_orders(spark: SparkSession, folder: str) -> DataFrame:
    """All orders, then their later states, which come a second time."""
    path, rows, changes = fresh_path(spark, "order-states"), inputs.order_states(spark, folder), inputs.order_changes(spark, folder)
    for batch in (rows, changes, changes):
        upsert.upsert(batch, path, ["order_id"], "changed_at", "placed")
    return upsert.read(spark, path, rows.schema).withColumn("placed", F.col("placed").cast("bigint"))


def _status_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.state_runs(warehouse.orders(spark, folder), "product_id", "status", "created_at", "inventory_item_id")


QUERIES: dict[str, Query] = {
    # cubes, nested data, sinks and table functions
    "user_cube": _user_cube,
    "sketched_user_cube": _sketched_user_cube,
    "conversation_blocks": _conversation_blocks,
    "payloads": _payloads,
    "payload_states": _payload_states,
    "upserted_orders": _upserted_orders,
    "status_runs": _status_runs,
    # stock
    "stock_as_of": _stock_as_of(stock.stock_position),
    "reorder_as_of": _stock_as_of(stock.reorder, threshold=12),
    "monthly_stock": lambda spark, folder: history.monthly_stock(warehouse.inventory_units(spark, folder)),
    "monthly_units_then": _monthly_units_then,
    # joins by time and by order
    "asof_last_event": _asof_last_event,
    "asof_last_price": _asof_last_price,
    "open_items_at_order": _open_items,
    "promoted_items": _promoted_items,
    "better_products": _better_products,
    "user_sessions": _user_sessions,
    "stream_monthly_units": _stream_monthly_units,
    "reply_recent": lambda spark, folder: reply("hello there", warehouse.tables(spark, folder), as_of=AS_OF),
    "stock_position": _star(stock.stock_position),
    "stock_position_flat": _flat_position,
    "top_sold": _star(stock.top_sold),
    "reorder": _star(stock.reorder),
    "slow_movers": _star(
        stock.slow_movers, threshold=SLOW_THRESHOLD, max_units=SLOW_MAX_UNITS
    ),
    "slow_movers_60d": _slow_movers_60d,
    "stock_overview": _star(stock.stock_overview),
    "monthly_units_stock": _monthly_units_stock,
    # sales
    "monthly_units": _orders(sales.monthly_units),
    "orders_by_value": _orders_by_value,
    "orders_recent": _orders(sales.orders_recent),
    "total_customers": _orders(sales.total_customers),
    "payouts": _payouts,
    "preview": _preview,
    # SQL and questions
    **{name: _free(name) for name in FREE_SQL},
    "ask_top_orders": _asked("top 25 orders by highest value"),
    "ask_reorder": _asked("which inventory items need a reorder, threshold 8?"),
    # profiles
    "table_shapes": _table_shapes,
    "column_manifest": _manifest,
    # loads
    "load_orders": _load_orders,
    "load_inventory": _load_inventory,
    "load_latin1": _load_documents(),
    "load_split_records": _load_documents(multiline=True),
    "load_skip_bad": _load_skip_bad,
    "load_mg_missing": _load_mg_missing,
    "load_aliases": _load_aliases,
    "load_report": _load_report,
    "enforce_schema": _enforce_schema,
    "coerce_types": _coerce_types,
    "coercion_report": _coercion_report,
    "nan_to_null": _nan_to_null,
    # log texts
    "route_questions": _route_questions,
    "clean_sql_log": _clean_sql_log,
    "audit_columns": _audit_columns,
    "suggest_columns": _suggest("levenshtein"),
    # analyses
    "monthly_trend": _orders(analyses.monthly_trend),
    "user_segments": _orders(analyses.user_segments),
    "unit_anomalies": _orders(analyses.unit_anomalies),
    "dq_checks": _dq_checks,
    "retention": _orders(analyses.retention),
}
