"""The same results in SQL for DuckDB over the given tables.

Written from the reports' definitions, not from the Spark plans: products are listed first and
counted by subquery, listings sort the joined table, expected texts are spelled out.
"""

from __future__ import annotations

from tallyshelf.operators import payouts as P
from tallyshelf.operators import textlog as X
from tallyshelf.operators.columns import MAX_SUGGESTIONS, MIN_SIMILARITY
from tallyshelf.schemas import TABLES
from workload import inputs
from workload.free_sql import FREE_SQL
from workload.queries import SLOW_MAX_UNITS, SLOW_THRESHOLD

_SQL_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}


def _declared(table: str, expressions: dict[str, str]) -> str:
    """A select list in declared order; columns without an expression are null."""
    items = []
    for field in TABLES[table].schema.fields:
        expression = expressions.get(field.name, "NULL")
        items.append(f"CAST({expression} AS {_SQL_TYPES[field.dataType.simpleString()]}) AS {field.name}")
    return ", ".join(items)


SHOP_ORDERS = "shop_orders AS (SELECT " + _declared("orders", {
    "order_id": "l_orderkey", "user_id": "o_custkey", "product_id": "l_partkey",
    "inventory_item_id": "l_orderkey * 10 + l_linenumber", "status": "o_orderstatus",
    "created_at": "o_orderdate", "shipped_at": "l_shipdate",
    "delivered_at": "CASE WHEN l_linestatus = 'F' THEN l_shipdate END",
    "returned_at": "CASE WHEN l_returnflag = 'R' THEN l_shipdate END",
    "sale_price": "l_extendedprice",
}) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"

SHOP_INVENTORY = "shop_inventory AS (SELECT " + _declared("inventory", {
    "product_id": "l_partkey", "created_at": "l_shipdate - INTERVAL '30' DAY",
    "sold_at": "CASE WHEN l_linestatus = 'F' THEN l_shipdate END",
    "cost": "p_retailprice / 2", "product_category": "p_type", "product_name": "p_name",
    "product_brand": "p_brand", "product_retail_price": "p_retailprice",
    "product_sku": "concat('SKU-', p_partkey)", "product_distribution_center_id": "l_suppkey",
}) + " FROM lineitem JOIN part ON l_partkey = p_partkey)"

SHOP_MG = """worked AS (
    SELECT strftime(ts, '%Y-%m') AS month, user_id, COUNT(DISTINCT CAST(ts AS DATE)) AS days,
           SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS delivered,
           SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors
    FROM events GROUP BY 1, 2
), shop_mg AS (SELECT """ + _declared("mg", {
    "month": "month", "id_user": "user_id", "name": "c_name", "fleet": "c_mktsegment",
    "city": "n_name",
    "vendor_name": "CASE WHEN user_id % 10 <> 0 THEN concat('VENDOR_', c_nationkey % 5) END",
    "rate": "10.0", "attendance": "days", "total_delivered_month": "delivered",
    "perfect_attendance": "CASE WHEN days >= 28 THEN 1 ELSE 0 END",
    "mg_eligible": "CASE WHEN days >= 28 THEN 1 ELSE 0 END",
    "monthly_mg": "200.0", "eligible_mg": "CASE WHEN days >= 28 THEN 200.0 ELSE 0.0 END",
    "payout": "delivered * 10.0", "fnd_ndr_penalty_amount": "errors * 2.0",
    "total_payout": "CASE WHEN user_id % 7 <> 0 THEN delivered * 10.0 - errors * 2.0 END",
    "da_level_final_amount": "CASE WHEN user_id % 7 <> 0 THEN delivered * 10.0 - errors * 2.0 END",
}) + " FROM worked JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def _with(*parts: str, query: str) -> str:
    return "WITH " + ", ".join(parts) + " " + query


# --- stock -------------------------------------------------------------------------------------

def _position(orders: str = "shop_orders") -> str:
    """Every product of either table, each figure by its own subquery; attributes by rejoining
    the unit rows."""
    return f"""
    position AS (
        SELECT p.product_id,
               MAX(u.product_name) AS product_name, MAX(u.product_brand) AS product_brand,
               MAX(u.product_category) AS product_category,
               (SELECT COUNT(*) FROM {orders} AS s WHERE s.product_id = p.product_id) AS units_sold,
               COUNT(u.product_id) - COUNT(u.sold_at) AS on_hand
        FROM (SELECT product_id FROM {orders} WHERE product_id IS NOT NULL
              UNION SELECT product_id FROM shop_inventory WHERE product_id IS NOT NULL) AS p
        LEFT JOIN shop_inventory AS u ON u.product_id = p.product_id
        GROUP BY p.product_id
    )"""


REPORT = "product_id, product_name, product_brand, product_category, units_sold, on_hand"


def _stock(tail: str) -> str:
    return _with(SHOP_ORDERS, SHOP_INVENTORY, _position(), query=f"SELECT {REPORT} FROM position {tail}")


_RECENT = """recent AS (
    SELECT * FROM shop_orders
    WHERE created_at > (SELECT MAX(created_at) FROM shop_orders) - INTERVAL '60' DAY
)"""

_STOCK = {
    "stock_position": _stock(""),
    "stock_position_flat": _stock(""),
    "top_sold": _stock("ORDER BY units_sold DESC, product_id LIMIT 5"),
    "reorder": _stock("WHERE on_hand < 10 ORDER BY on_hand, units_sold DESC, product_id LIMIT 100"),
    "ask_reorder": _stock(
        "WHERE on_hand < 8 ORDER BY on_hand, units_sold DESC, product_id LIMIT 100"),
    "slow_movers": _stock(
        f"WHERE on_hand >= {SLOW_THRESHOLD} AND units_sold <= {SLOW_MAX_UNITS} "
        "ORDER BY on_hand DESC, product_id LIMIT 100"),
    "slow_movers_60d": _with(
        SHOP_ORDERS, SHOP_INVENTORY, _RECENT, _position("recent"),
        query=f"SELECT {REPORT} FROM position WHERE on_hand >= 10 AND units_sold <= 1 "
              "ORDER BY on_hand DESC, product_id LIMIT 100"),
    "stock_overview": _stock("ORDER BY units_sold DESC, on_hand, product_id LIMIT 100"),
    "monthly_units_stock": _with(SHOP_ORDERS, SHOP_INVENTORY, query="""
        SELECT m.year_month, m.product_id, MAX(u.product_name) AS product_name,
               MAX(u.product_brand) AS product_brand, MAX(u.product_category) AS product_category,
               m.units_sold, COUNT(u.product_id) - COUNT(u.sold_at) AS on_hand
        FROM (SELECT date_trunc('month', created_at) AS year_month, product_id,
                     COUNT(*) AS units_sold
              FROM shop_orders WHERE created_at IS NOT NULL AND product_id IS NOT NULL
              GROUP BY ALL) AS m
        LEFT JOIN shop_inventory AS u ON u.product_id = m.product_id
        GROUP BY m.year_month, m.product_id, m.units_sold
        ORDER BY m.year_month DESC, m.units_sold DESC, m.product_id"""),
}

# --- sales -------------------------------------------------------------------------------------

_BY_PRICE = ("ORDER BY sale_price DESC NULLS LAST, order_id, user_id, product_id, "
             "inventory_item_id, status, created_at, shipped_at, delivered_at, returned_at")
_BY_DATE = ("ORDER BY created_at DESC NULLS LAST, order_id, user_id, product_id, "
            "inventory_item_id, status, shipped_at, delivered_at, returned_at, sale_price")

_SALES = {
    "orders_by_value": _with(SHOP_ORDERS, query=f"SELECT * FROM shop_orders {_BY_PRICE} LIMIT 500"),
    "ask_top_orders": _with(SHOP_ORDERS, query=f"SELECT * FROM shop_orders {_BY_PRICE} LIMIT 25"),
    "orders_recent": _with(SHOP_ORDERS, query=f"SELECT * FROM shop_orders {_BY_DATE}"),
    "preview": _with(SHOP_ORDERS, query=f"""
        SELECT *, (SELECT COUNT(*) FROM shop_orders) AS total_rows
        FROM shop_orders {_BY_DATE} LIMIT 50"""),
    "monthly_units": _with(SHOP_ORDERS, query="""
        SELECT date_trunc('month', created_at) AS month, product_id, COUNT(*) AS units
        FROM shop_orders WHERE created_at IS NOT NULL AND product_id IS NOT NULL
        GROUP BY ALL ORDER BY month DESC, product_id"""),
    "total_customers": _with(SHOP_ORDERS, query=(
        "SELECT COUNT(*) AS total_customers FROM "
        "(SELECT DISTINCT user_id FROM shop_orders WHERE user_id IS NOT NULL) AS u")),
    "payouts": _with(SHOP_MG, query=(
        f"SELECT {', '.join(P.PAYOUT_COLUMNS)} FROM shop_mg "
        "ORDER BY total_payout DESC NULLS LAST, id_user, month LIMIT 200")),
}

_FREE = {
    name: _with(SHOP_ORDERS, SHOP_INVENTORY, SHOP_MG, query="SELECT * FROM (" + text.format(
        orders="shop_orders", inventory="shop_inventory", mg="shop_mg") + ") AS q")
    for name, text in FREE_SQL.items()
}

# --- profiles ----------------------------------------------------------------------------------


def _manifest_row(table: str, position: int, name: str, dtype: str, chars: int) -> str:
    sample = {
        "string": f"MIN(substring({name}, 1, {chars}))",
        "bigint": f"substring(CAST(MIN({name}) AS VARCHAR), 1, {chars})",
        "timestamp_ntz": f"strftime(MIN({name}), '%Y-%m-%d %H:%M:%S')",
        "double": f"regexp_replace(CAST(TRY_CAST(MIN({name}) AS DECIMAL(38, 6)) AS VARCHAR), '0{{1,5}}$', '')",
    }[dtype]
    return (f"SELECT '{table}' AS table_name, '{name}' AS column_name, "
            f"CAST({position} AS BIGINT) AS position, '{dtype}' AS data_type, "
            f"COUNT(*) > COUNT({name}) AS has_nulls, {sample} AS sample FROM shop_{table}")


def _manifest(chars: int) -> str:
    return " UNION ALL ".join(
        _manifest_row(table, i, f.name, f.dataType.simpleString(), chars)
        for table, spec in TABLES.items() for i, f in enumerate(spec.schema.fields, start=1)
    )


_PROFILES = {
    "table_shapes": _with(SHOP_ORDERS, SHOP_INVENTORY, SHOP_MG, query=" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, "
        f"CAST({len(s.columns)} AS BIGINT) AS column_count FROM shop_{t}"
        for t, s in TABLES.items())),
    "column_manifest": _with(SHOP_ORDERS, SHOP_INVENTORY, SHOP_MG, query=_manifest(40)),
}

# --- loads -------------------------------------------------------------------------------------

_DOCUMENTS = "SELECT " + _declared("inventory", {
    "product_id": "doc_id", "product_name": "nullif(text, '')", "product_brand": "source", "product_category": "lang",
}) + " FROM documents"

_LOADS = {
    "load_orders": _with(SHOP_ORDERS, query="SELECT * FROM shop_orders"),
    "load_inventory": _with(SHOP_INVENTORY, query="SELECT * FROM shop_inventory"),
    "load_mg_missing": _with(SHOP_MG, query="SELECT * FROM shop_mg"),
    "load_latin1": _DOCUMENTS,
    "load_split_records": _DOCUMENTS,
    "load_skip_bad": "SELECT " + _declared("orders", {
        "order_id": "l_orderkey", "product_id": "l_partkey",
        "inventory_item_id":
            "CASE WHEN l_orderkey % 7 <> 0 THEN l_orderkey * 10 + l_linenumber END",
        "shipped_at": "CASE WHEN l_orderkey % 7 <> 0 THEN l_shipdate END",
        "sale_price": "CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END",
    }) + " FROM lineitem WHERE l_orderkey % 5 <> 0",
    "load_aliases": "SELECT " + _declared("orders", {
        "order_id": "o_orderkey", "user_id": "o_custkey", "created_at": "o_orderdate",
    }) + " FROM orders",
    "load_report": _with(SHOP_MG, query="""
        SELECT 'orders' AS table_name, FALSE AS missing, FALSE AS latin1,
               FALSE AS multiline, 'skip' AS bad_rows, CAST(5 AS BIGINT) AS cols,
               SUM(CASE WHEN l_orderkey % 5 <> 0 THEN 1 ELSE 0 END)::BIGINT AS row_count,
               SUM(CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS skipped_rows,
               CAST(0 AS BIGINT) AS tried_paths FROM lineitem
        UNION ALL SELECT 'inventory', FALSE, TRUE, TRUE, 'skip', 4, COUNT(*), 0, 0
        FROM documents
        UNION ALL SELECT 'mg', FALSE, FALSE, FALSE, 'skip', 25, COUNT(*), 0, 2 FROM shop_mg
        UNION ALL SELECT 'mg', TRUE, FALSE, FALSE, 'skip', 25, 0, 0, 1"""),
    "enforce_schema": _with(SHOP_ORDERS, query=(
        "SELECT * REPLACE (CAST(NULL AS TIMESTAMP) AS returned_at, "
        "CAST(NULL AS BIGINT) AS inventory_item_id) FROM shop_orders")),
    "coerce_types": _with(SHOP_ORDERS, query="""
        SELECT CASE WHEN inventory_item_id % 41 <> 0 THEN inventory_item_id END AS id,
               CASE WHEN order_id % 11 <> 0 THEN order_id END AS order_id, user_id, product_id,
               CASE WHEN inventory_item_id % 31 <> 0 THEN inventory_item_id END AS inventory_item_id,
               CASE WHEN product_id % 7 <> 0 THEN shipped_at END AS shipped_at,
               CASE WHEN product_id % 5 <> 0 THEN delivered_at ELSE date_trunc('day', delivered_at) END AS delivered_at,
               returned_at - INTERVAL '2 hours' AS returned_at,
               CASE WHEN product_id % 29 <> 0 THEN status END AS status,
               CASE WHEN order_id % 5 = 0 THEN created_at - INTERVAL '5 hours 30 minutes'
                    WHEN order_id % 19 = 0 THEN date_trunc('day', created_at)
                    WHEN order_id % 23 <> 0 THEN created_at END AS created_at,
               CASE WHEN product_id % 13 <> 0 AND product_id % 17 <> 0 THEN sale_price END
                   AS sale_price
        FROM shop_orders"""),
    "coercion_report": _with(SHOP_ORDERS, query="""
        SELECT 'orders' AS table_name, 'order_id' AS column_name, COUNT(*) AS given,
               COUNT(*) FILTER (WHERE order_id % 11 = 0) AS failed FROM shop_orders
        UNION ALL SELECT 'orders', 'id', COUNT(*), COUNT(*) FILTER (WHERE inventory_item_id % 41 = 0) FROM shop_orders
        UNION ALL SELECT 'orders', 'inventory_item_id', COUNT(*), COUNT(*) FILTER (WHERE inventory_item_id % 31 = 0) FROM shop_orders
        UNION ALL SELECT 'orders', 'shipped_at', COUNT(*) FILTER (WHERE product_id % 7 = 0 OR shipped_at IS NOT NULL),
            COUNT(*) FILTER (WHERE product_id % 7 = 0) FROM shop_orders
        UNION ALL SELECT 'orders', 'delivered_at', COUNT(delivered_at), 0 FROM shop_orders
        UNION ALL SELECT 'orders', 'returned_at', COUNT(returned_at), 0 FROM shop_orders
        UNION ALL SELECT 'orders', 'user_id', COUNT(user_id), 0 FROM shop_orders
        UNION ALL SELECT 'orders', 'product_id', COUNT(product_id), 0 FROM shop_orders
        UNION ALL SELECT 'orders', 'status', COUNT(*) FILTER (WHERE product_id % 29 <> 0), 0
        FROM shop_orders
        UNION ALL SELECT 'orders', 'created_at', COUNT(*), COUNT(*) FILTER (
            WHERE order_id % 23 = 0 AND order_id % 5 <> 0 AND order_id % 19 <> 0) FROM shop_orders
        UNION ALL SELECT 'orders', 'sale_price', COUNT(*) FILTER (WHERE product_id % 13 <> 0),
            COUNT(*) FILTER (WHERE product_id % 17 = 0 AND product_id % 13 <> 0) FROM shop_orders"""),
    "nan_to_null": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id,
               l_orderkey * 10 + l_linenumber AS inventory_item_id, l_shipdate AS shipped_at,
               CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS delivered_at,
               CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS returned_at,
               CASE WHEN l_partkey % 7 <> 0 THEN l_extendedprice END AS sale_price
        FROM lineitem""",
}

# --- log texts ---------------------------------------------------------------------------------

_QUESTIONS = """questions AS (
    SELECT event_id AS question_id, CASE event_type
        WHEN 'click' THEN concat('Show me top ', user_id, ' most sold items in inventory')
        WHEN 'view' THEN concat('inventory items to reorder below ', user_id)
        WHEN 'purchase' THEN concat('top ', user_id, ' orders by highest value')
        WHEN 'signup' THEN 'minimum guarantee by city'
        ELSE 'monthly inventory units' END AS question
    FROM events
    UNION ALL
    SELECT -1 - (conv_id * 1000 + turn), text FROM conversations WHERE role = 'user'
)"""


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


def _number(pattern: str, group: int, default: int) -> str:
    return f"COALESCE(TRY_CAST(NULLIF(regexp_extract(q, '{pattern}', {group}), '') AS BIGINT), {default})"


_ROUTES = _with(_QUESTIONS, query=f"""
    SELECT question_id, question, route, sub_route,
        CAST(CASE WHEN route = 'payouts' THEN 200
             WHEN route = 'orders_by_value' THEN {_number(X.ORDER_LIMIT_PATTERN, 2, 500)}
             WHEN sub_route = 'top_sold' THEN {_number(X.TOP_N_PATTERN, 1, 5)}
             WHEN sub_route IN ('reorder', 'slow', 'overview') THEN 100 END AS BIGINT) AS row_limit,
        CASE WHEN sub_route IN ('reorder', 'slow')
             THEN {_number(X.THRESHOLD_PATTERN, 2, 10)} END AS threshold
    FROM (SELECT *, CASE WHEN route <> 'inventory' THEN NULL
              WHEN {_has(X.MONTHLY_WORDS)} THEN 'monthly'
              WHEN {_has(X.TOP_SOLD_WORDS)} THEN 'top_sold'
              WHEN {_has(X.REORDER_WORDS)} THEN 'reorder'
              WHEN {_has(X.SLOW_WORDS)} THEN 'slow'
              ELSE 'overview' END AS sub_route
          FROM (SELECT *, CASE WHEN contains(q, '{X.CUSTOMER_PHRASE}') THEN 'total_customers'
                    WHEN regexp_matches(q, '{X.PAYOUT_PATTERN}') THEN 'payouts'
                    WHEN {_has(X.INVENTORY_WORDS)} THEN 'inventory'
                    WHEN contains(q, 'orders') AND contains(q, 'value')
                         AND {_has(X.DESCENDING_WORDS)} THEN 'orders_by_value'
                    ELSE 'none' END AS route
                FROM (SELECT *, lower(COALESCE(question, '')) AS q FROM questions) AS a) AS b) AS c""")


def _pick(key: str, names: list[str]) -> str:
    return "list_extract([" + ", ".join(f"'{n}'" for n in names) + f"], ({key}) % {len(names)} + 1)"


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(r) + ")" for r in rows)


_DICTIONARY = "dictionary(table_name, candidate, position, place) AS (VALUES " + _values([
    (f"'{t}'", f"'{c}'", str(i), str(list(s.synonyms).index(c) + 1 if c in s.synonyms else "NULL"))
    for t, s in TABLES.items() for i, c in enumerate(s.columns, start=1)
]) + ")"

_SYNONYMS = "synonyms(table_name, candidate, word) AS (VALUES " + _values([
    (f"'{t}'", f"'{c}'", f"'{w}'") for t, s in TABLES.items() for c, ws in s.synonyms.items()
    for w in [c, *ws]
]) + ")"

# Which columns each logged query names, straight from how the log is made.
_REFERENCES = f"""named AS (
    SELECT event_id AS query_id, 'orders' AS table_name,
           lower({_pick('event_id', inputs.ORDER_NAMES)}) AS column_name FROM events
    WHERE event_id % 4 = 0 OR event_id % 3 <> 0
    UNION SELECT event_id, 'orders', lower({_pick('event_id + 3', inputs.ORDER_NAMES)}) FROM events
    WHERE event_id % 4 <> 0 AND event_id % 3 <> 0
    UNION SELECT event_id, 'inventory', lower({_pick('event_id', inputs.INVENTORY_NAMES)}) FROM events
    WHERE event_id % 4 <> 0 AND event_id % 3 <> 0
    UNION SELECT event_id, 'mg', lower({_pick('event_id', inputs.MG_NAMES)}) FROM events
    WHERE event_id % 4 <> 0 AND event_id % 3 = 0
), missing AS (
    SELECT * FROM named WHERE NOT EXISTS (
        SELECT 1 FROM dictionary AS d
        WHERE d.table_name = named.table_name AND d.candidate = named.column_name)
)"""

_SUGGESTED = f"""words AS (SELECT DISTINCT table_name, column_name FROM missing),
pairs AS (
    SELECT w.table_name, w.column_name, d.candidate, d.position, d.place,
           1.0 - levenshtein(d.candidate, w.column_name)::DOUBLE
               / greatest(length(d.candidate), length(w.column_name)) AS ratio,
           EXISTS (SELECT 1 FROM synonyms AS s WHERE s.table_name = w.table_name
                   AND s.candidate = d.candidate AND s.word = w.column_name) AS synonym
    FROM words AS w JOIN dictionary AS d ON d.table_name = w.table_name
), near AS (
    SELECT *, CASE WHEN ratio >= {MIN_SIMILARITY} THEN ROW_NUMBER() OVER (
        PARTITION BY table_name, column_name, ratio >= {MIN_SIMILARITY}
        ORDER BY ratio DESC, candidate DESC) END AS near_rank
    FROM pairs
), reasons AS (
    SELECT *, CASE WHEN synonym THEN 1
                   WHEN contains(candidate, column_name) OR contains(column_name, candidate) THEN 2
                   WHEN near_rank <= {MAX_SUGGESTIONS} THEN 3 END AS class
    FROM near
), chosen AS (
    SELECT table_name, column_name, candidate AS suggestion, ROW_NUMBER() OVER (
        PARTITION BY table_name, column_name
        ORDER BY class, CASE class WHEN 1 THEN place WHEN 2 THEN position ELSE near_rank END
    ) AS rank
    FROM reasons WHERE class IS NOT NULL
), manifest AS ({_manifest(80)})"""

_TEXTS = {
    "route_questions": _ROUTES,
    "clean_sql_log": """
        SELECT event_id AS reply_id, CASE
            WHEN event_id % 7 = 0 THEN ''
            WHEN event_id % 5 = 0 THEN concat('WITH t AS (SELECT user_id FROM orders  WHERE user_id = ',
                                              user_id, ') SELECT * FROM t')
            ELSE concat('select * FROM orders WHERE user_id = ', user_id, ' ', chr(10),
                        'ORDER BY created_at DESC') END AS sql
        FROM events""",
    "audit_columns": _with(
        _DICTIONARY, _REFERENCES, query="SELECT query_id, table_name, column_name FROM missing"),
    "suggest_columns": _with(
        SHOP_ORDERS, SHOP_INVENTORY, SHOP_MG, _DICTIONARY, _SYNONYMS, _REFERENCES, _SUGGESTED,
        query=f"""
        SELECT c.table_name, c.column_name, c.rank, c.suggestion, m.sample
        FROM chosen AS c LEFT JOIN manifest AS m
          ON m.table_name = c.table_name AND m.column_name = c.suggestion
        WHERE c.rank <= {MAX_SUGGESTIONS}"""),
}

# --- analyses ----------------------------------------------------------------------------------


def _null_check(table: str, column: str) -> str:
    return (f"SELECT 'null' AS check_name, '{table}' AS table_name, '{column}' AS column_name, "
            f"COUNT(*) - COUNT({column}) AS failed, COUNT(*) AS checked FROM shop_{table}")


_ANALYSES = {
    "monthly_trend": _with(SHOP_ORDERS, query="""
        SELECT month, order_count, units, CAST(total AS DOUBLE) AS revenue,
               CAST(total - LAG(total) OVER (ORDER BY month) AS DOUBLE) AS revenue_change
        FROM (SELECT date_trunc('month', created_at) AS month,
                     COUNT(DISTINCT order_id) AS order_count, COUNT(*) AS units,
                     SUM(CAST(sale_price AS DECIMAL(18, 2))) AS total
              FROM shop_orders WHERE created_at IS NOT NULL GROUP BY 1) AS m ORDER BY month"""),
    # Cut points by rank: the value at position ceil(n * share) of the sorted spends.
    "user_segments": _with(
        SHOP_ORDERS,
        """spends AS (
            SELECT user_id, COUNT(*) AS units,
                   CAST(SUM(CAST(sale_price AS DECIMAL(18, 2))) AS DOUBLE) AS spend
            FROM shop_orders WHERE user_id IS NOT NULL GROUP BY user_id
        ), cuts AS (SELECT list_sort(list(spend)) AS ranked, COUNT(spend) AS n FROM spends)""",
        query="""
        SELECT s.user_id, s.units, s.spend,
               CAST(1 + (CASE WHEN s.spend > c.ranked[ceil(c.n * 0.25)::INT] THEN 1 ELSE 0 END)
                      + (CASE WHEN s.spend > c.ranked[ceil(c.n * 0.5)::INT] THEN 1 ELSE 0 END)
                      + (CASE WHEN s.spend > c.ranked[ceil(c.n * 0.75)::INT] THEN 1 ELSE 0 END)
                    AS BIGINT) AS segment
        FROM spends AS s, cuts AS c"""),
    "unit_anomalies": _with(SHOP_ORDERS, query="""
        SELECT month, product_id, units, z_score FROM (
            SELECT month, product_id, units,
                   ROUND((units - AVG(units) OVER w) / STDDEV_SAMP(units) OVER w, 6) AS z_score
            FROM (SELECT *, STDDEV_SAMP(units) OVER (PARTITION BY product_id) AS spread
                  FROM (SELECT date_trunc('month', created_at) AS month, product_id,
                               COUNT(*) AS units
                        FROM shop_orders WHERE created_at IS NOT NULL AND product_id IS NOT NULL
                        GROUP BY ALL) AS m) AS s
            WHERE spread > 0 WINDOW w AS (PARTITION BY product_id)) AS z
        WHERE abs(z_score) >= 2.0 ORDER BY z_score DESC, month, product_id"""),
    "retention": _with(SHOP_ORDERS, query="""
        SELECT f.cohort, datediff('month', f.cohort, o.created_at) AS months_later,
               COUNT(DISTINCT o.user_id) AS users
        FROM shop_orders AS o
        JOIN (SELECT user_id, date_trunc('month', MIN(created_at)) AS cohort
              FROM shop_orders GROUP BY user_id) AS f ON f.user_id = o.user_id
        WHERE o.created_at IS NOT NULL GROUP BY 1, 2 ORDER BY 1, 2"""),
    "dq_checks": _with(SHOP_ORDERS, SHOP_INVENTORY, SHOP_MG, query=" UNION ALL ".join(
        [_null_check(t, c) for t, s in TABLES.items() for c in s.columns] + ["""
        SELECT 'duplicate_key', 'orders', 'order_id,inventory_item_id',
               COUNT(*) - COUNT(DISTINCT (order_id, inventory_item_id)), COUNT(*) FROM shop_orders
        UNION ALL SELECT 'duplicate_key', 'mg', 'month,id_user',
               COUNT(*) - COUNT(DISTINCT (month, id_user)), COUNT(*) FROM shop_mg
        UNION ALL SELECT 'orphan_key', 'orders', 'product_id', COUNT(*) FILTER (
               WHERE product_id NOT IN (SELECT product_id FROM shop_inventory)), COUNT(product_id)
               FROM shop_orders
        UNION ALL SELECT 'before_created_at', 'orders', 'shipped_at',
               COUNT(*) FILTER (WHERE shipped_at < created_at),
               COUNT(*) FILTER (WHERE shipped_at IS NOT NULL AND created_at IS NOT NULL)
               FROM shop_orders
        UNION ALL SELECT 'before_created_at', 'inventory', 'sold_at',
               COUNT(*) FILTER (WHERE sold_at < created_at),
               COUNT(*) FILTER (WHERE sold_at IS NOT NULL AND created_at IS NOT NULL)
               FROM shop_inventory"""])),
}

# --- histories, joins by time and by order ----------------------------------------------------------

_THEN = """known_orders AS (SELECT * FROM shop_orders WHERE created_at <= TIMESTAMP '1999-07-01 12:00:00'),
known_inventory AS (
    SELECT * REPLACE (CASE WHEN sold_at <= TIMESTAMP '1999-07-01 12:00:00' THEN sold_at END AS sold_at)
    FROM shop_inventory WHERE created_at <= TIMESTAMP '1999-07-01 12:00:00'
)"""
_POSITION_THEN = _position("known_orders").replace("shop_inventory", "known_inventory")

_HISTORIES = {
    "stock_as_of": _with(SHOP_ORDERS, SHOP_INVENTORY, _THEN, _POSITION_THEN, query=f"SELECT {REPORT} FROM position"),
    "reorder_as_of": _with(
        SHOP_ORDERS, SHOP_INVENTORY, _THEN, _POSITION_THEN,
        query=f"SELECT {REPORT} FROM position WHERE on_hand < 12 ORDER BY on_hand, units_sold DESC, product_id LIMIT 100"),
    "reply_recent": _with(SHOP_ORDERS, query=f"""
        SELECT * REPLACE (CASE WHEN shipped_at <= TIMESTAMP '1999-07-01 12:00:00' THEN shipped_at END AS shipped_at,
                          CASE WHEN delivered_at <= TIMESTAMP '1999-07-01 12:00:00' THEN delivered_at END AS delivered_at,
                          CASE WHEN returned_at <= TIMESTAMP '1999-07-01 12:00:00' THEN returned_at END AS returned_at),
               COUNT(*) OVER () AS total_rows
        FROM shop_orders WHERE created_at <= TIMESTAMP '1999-07-01 12:00:00' {_BY_DATE} LIMIT 50"""),
    # The stock of a month's end is counted afresh from the units, not summed up from events.
    "monthly_stock": _with(SHOP_INVENTORY, query="""
        SELECT product_id, month, received, sold, (
            SELECT COUNT(*) FILTER (date_trunc('month', u.created_at) <= m.month) - COUNT(*) FILTER (date_trunc('month', u.sold_at) <= m.month)
            FROM shop_inventory u WHERE u.product_id = m.product_id) AS on_hand
        FROM (SELECT product_id, month, CAST(SUM(r) AS BIGINT) AS received, CAST(SUM(s) AS BIGINT) AS sold FROM (
                  SELECT product_id, date_trunc('month', created_at) AS month, 1 AS r, 0 AS s FROM shop_inventory
                  UNION ALL SELECT product_id, date_trunc('month', sold_at), 0, 1 FROM shop_inventory WHERE sold_at IS NOT NULL)
              GROUP BY ALL) AS m"""),
    "monthly_units_then": _with(SHOP_ORDERS, SHOP_INVENTORY, query="""
        SELECT m.year_month, m.product_id, MAX(u.product_name) AS product_name, MAX(u.product_brand) AS product_brand,
               MAX(u.product_category) AS product_category, m.units_sold,
               COUNT(*) FILTER (date_trunc('month', u.created_at) <= m.year_month)
               - COUNT(*) FILTER (date_trunc('month', u.sold_at) <= m.year_month) AS on_hand
        FROM (SELECT date_trunc('month', created_at) AS year_month, product_id, COUNT(*) AS units_sold
              FROM shop_orders WHERE created_at IS NOT NULL AND product_id IS NOT NULL GROUP BY ALL) AS m
        LEFT JOIN shop_inventory AS u ON u.product_id = m.product_id
        GROUP BY m.year_month, m.product_id, m.units_sold"""),
    "asof_last_event": """
        SELECT event_id, user_id, ts, best.ts AS last_ts, best.event_type AS last_type, best.event_id AS last_event_id FROM (
            SELECT p.event_id, p.user_id, p.ts, MAX(CASE WHEN e.event_id IS NOT NULL THEN
                {'ts': e.ts, 'event_type': e.event_type, 'event_id': e.event_id} END) AS best
            FROM events p LEFT JOIN events e ON e.user_id = p.user_id AND e.ts <= p.ts AND e.event_type <> 'purchase'
            WHERE p.event_type = 'purchase' GROUP BY ALL)""",
    "asof_last_price": _with(SHOP_ORDERS, query="""
        SELECT inventory_item_id, product_id, created_at, sale_price, best.price AS price_before, best.at AS priced_at FROM (
            SELECT o.inventory_item_id, o.product_id, o.created_at, o.sale_price, o.number, MAX(CASE WHEN e.product_id IS NOT NULL THEN
                {'at': e.created_at, 'price': e.sale_price} END) AS best
            FROM (SELECT *, row_number() OVER () AS number FROM shop_orders) o
            LEFT JOIN shop_orders e ON e.product_id = o.product_id AND e.created_at < o.created_at GROUP BY ALL)"""),
    "open_items_at_order": _with(SHOP_ORDERS, query="""
        SELECT h.o_orderkey AS order_id, COUNT(*) AS open_items
        FROM orders h JOIN shop_orders i ON i.user_id = h.o_custkey AND i.created_at < h.o_orderdate AND h.o_orderdate < i.shipped_at
        GROUP BY ALL"""),
    "promoted_items": _with(SHOP_ORDERS, """promotions AS (
            SELECT p_partkey AS product_id, s AS promo_start, s + to_days(p_size * 7) AS promo_end
            FROM (SELECT *, TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 1800 AS INTEGER)) AS s FROM part)
            UNION ALL SELECT p_partkey, s, s + to_days(p_size)
            FROM (SELECT *, TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey * 7 % 2400 AS INTEGER)) AS s FROM part))""", query="""
        SELECT inventory_item_id, product_id, created_at, shipped_at, promo_start, promo_end
        FROM shop_orders JOIN promotions USING (product_id)
        WHERE created_at < shipped_at AND promo_start < promo_end AND created_at < promo_end AND promo_start < shipped_at"""),
    "better_products": """
        WITH p AS (SELECT p_partkey AS product_id, p_retailprice AS product_retail_price, COUNT(*) AS units_sold
                   FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)
        SELECT x.*, (SELECT COUNT(*) FROM p y WHERE y.product_retail_price <= x.product_retail_price AND y.units_sold >= x.units_sold
                     AND (y.product_retail_price < x.product_retail_price OR y.units_sold > x.units_sold)) AS beaten_by
        FROM p x""",
    "user_sessions": """
        SELECT user_id, session, MIN(ts) AS session_start, MAX(ts) AS session_end, COUNT(*) AS events,
               COUNT(*) FILTER (event_type = 'purchase') AS purchases, CAST(SUM(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS value
        FROM (SELECT *, CAST(1 + SUM(CAST(ts > before + INTERVAL '7200' SECOND AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session
              FROM (SELECT *, coalesce(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS before FROM events))
        GROUP BY user_id, session""",
    "stream_monthly_units": _with(SHOP_ORDERS, query="""
        SELECT date_trunc('month', created_at) AS month, product_id, COUNT(*) AS units
        FROM shop_orders WHERE created_at IS NOT NULL AND product_id IS NOT NULL
          AND NOT (year(created_at) < 1998 AND order_id % 50 = 0) GROUP BY ALL"""),
}

_VISITS = """visits AS (SELECT user_id, year(ts) AS year_of, event_type, hour(ts) >= 18 AS evening FROM events)"""
_CUBED = "year_of, event_type, evening, CAST(GROUPING_ID(year_of, event_type, evening) AS BIGINT) AS level, COUNT(*) AS row_count"

_SAID = """said AS (
    SELECT *, conv_id IS NOT NULL AND role IS NOT DISTINCT FROM LAG(role) OVER w AND ROW_NUMBER() OVER w > 1 AS same,
           coalesce(greatest(turn - LAG(turn) OVER w - 1, 0), 0) AS gap,
           len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS words
    FROM (SELECT DISTINCT conv_id, CAST(floor(turn / 1000) AS BIGINT) AS block, turn, role, text
          FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
    WINDOW w AS (PARTITION BY conv_id, block ORDER BY turn, role, text)
)"""

_SENT = """sent AS (
    SELECT event_id, user_id, event_type, CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) AS value,
           CASE WHEN event_id % 17 <> 0 THEN '{"user": ' || CASE WHEN event_id % 11 = 0 THEN '"u' || user_id || '"' ELSE '' || user_id END
               || ', "kind": "' || event_type || '", "value": ' || CAST(value AS DECIMAL(18, 2)) || ', "tags": ["a", "b"]'
               || CASE WHEN event_id % 7 = 0 THEN ', "note": "x"' ELSE '' END || CASE WHEN event_id % 13 = 0 THEN '' ELSE '}' END END AS text
    FROM events
)"""

_MORE = {
    "user_cube": _with(_VISITS, query=f"""
        SELECT {_CUBED}, COUNT(DISTINCT user_id) AS users FROM visits GROUP BY CUBE (year_of, event_type, evening)"""),
    "sketched_user_cube": _with(_VISITS, query=f"""
        SELECT {_CUBED}, TRUE AS near FROM visits GROUP BY CUBE (year_of, event_type, evening)"""),
    "conversation_blocks": _with(_SAID, query="""
        SELECT t.conv_id, t.block, COUNT(*) AS n_turns, COUNT(*) FILTER (same) AS same_role, CAST(SUM(gap) AS BIGINT) AS left_out,
               (SELECT coalesce(string_agg(role || ':' || n, ',' ORDER BY role), '') FROM (
                    SELECT role, SUM(words) AS n FROM said s
                    WHERE s.conv_id = t.conv_id AND s.block = t.block AND role IS NOT NULL GROUP BY role)) AS words_by_role
        FROM said t GROUP BY t.conv_id, t.block"""),
    "payloads": _with(_SENT, query="""
        SELECT event_id, CASE WHEN state IN ('fits', 'surplus') THEN user_id END AS "user",
               CASE WHEN state NOT IN ('missing', 'broken') THEN event_type END AS kind,
               CASE WHEN state NOT IN ('missing', 'broken') THEN value END AS value,
               CASE WHEN state NOT IN ('missing', 'broken') THEN 'a+b' END AS tags, state, CASE WHEN state <> 'fits' THEN text END AS raw
        FROM (SELECT *, CASE WHEN text IS NULL THEN 'missing' WHEN event_id % 13 = 0 THEN 'broken' WHEN event_id % 11 = 0 THEN 'misfit'
                             WHEN event_id % 7 = 0 THEN 'surplus' ELSE 'fits' END AS state FROM sent)"""),
    "payload_states": _with(_SENT, query="""
        SELECT CASE WHEN text IS NULL THEN 'missing' WHEN event_id % 13 = 0 THEN 'broken' ELSE 'fits' END AS state, COUNT(*) AS row_count
        FROM sent GROUP BY ALL"""),
    "upserted_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS created_at,
               CASE WHEN o_orderkey % 20 = 0 THEN 'C' WHEN o_orderkey % 10 = 0 THEN 'R' ELSE o_orderstatus END AS status,
               o_orderdate + to_days(CASE WHEN o_orderkey % 20 = 0 THEN 9 WHEN o_orderkey % 10 = 0 THEN 5 ELSE 0 END) AS changed_at,
               year(o_orderdate) + CASE WHEN o_orderkey % 70 = 0 THEN 1 ELSE 0 END AS placed
        FROM orders""",
    "status_runs": _with(SHOP_ORDERS, query="""
        SELECT product_id, CAST(run AS BIGINT) AS run, status, MIN(created_at) AS run_start, MAX(created_at) AS run_end, COUNT(*) AS items
        FROM (SELECT *, SUM(begins) OVER (PARTITION BY product_id ORDER BY created_at, inventory_item_id ROWS UNBOUNDED PRECEDING) AS run
              FROM (SELECT *, CASE WHEN LAG(order_id) OVER w IS NULL OR status IS DISTINCT FROM LAG(status) OVER w THEN 1 ELSE 0 END AS begins
                    FROM shop_orders WHERE product_id IS NOT NULL AND created_at IS NOT NULL
                    WINDOW w AS (PARTITION BY product_id ORDER BY created_at, inventory_item_id)))
        GROUP BY product_id, run, status"""),
}

ORACLE: dict[str, str] = {
    **_MORE, **_STOCK, **_SALES, **_FREE, **_PROFILES, **_LOADS, **_TEXTS, **_ANALYSES, **_HISTORIES
}
