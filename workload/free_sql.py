"""Free queries over the three tables, in SQL that Spark and DuckDB both run.

Table names are placeholders: ``{orders}``, ``{inventory}``, ``{mg}``.
"""

FREE_SQL = {
    # Two grouped tables joined on their key, so a popular product is one row on each side.
    "free_select": """
        WITH sold AS (
            SELECT product_id, COUNT(*) AS units, SUM(CAST(sale_price AS DECIMAL(18, 2))) AS total
            FROM {orders} WHERE product_id IS NOT NULL GROUP BY product_id
        ), held AS (
            SELECT product_id, product_category AS category,
                   SUM(CASE WHEN sold_at IS NULL THEN 1 ELSE 0 END) AS on_hand
            FROM {inventory} WHERE product_id IS NOT NULL GROUP BY product_id, product_category
        )
        SELECT held.category AS category, COUNT(*) AS products,
               CAST(SUM(sold.units) AS BIGINT) AS units,
               CAST(SUM(held.on_hand) AS BIGINT) AS on_hand,
               CAST(SUM(sold.total) AS DOUBLE) AS revenue
        FROM held LEFT JOIN sold ON sold.product_id = held.product_id
        GROUP BY held.category ORDER BY category
    """,
    # A rank bound inside each month: Spark prunes to the bound before it shuffles.
    "free_select_window": """
        SELECT year_of, product_id, units, CAST(place AS BIGINT) AS place FROM (
            SELECT year_of, product_id, units,
                   ROW_NUMBER() OVER (PARTITION BY year_of ORDER BY units DESC, product_id) AS place
            FROM (
                SELECT CAST(EXTRACT(YEAR FROM created_at) AS BIGINT) AS year_of, product_id,
                       COUNT(*) AS units
                FROM {orders} GROUP BY 1, 2
            ) AS yearly
        ) AS ranked WHERE place <= 3 ORDER BY year_of, place
    """,
    # Grouped finely first: the rollup then multiplies a few groups, not all rows.
    "free_select_rollup": """
        SELECT status, year_of, CAST(SUM(items) AS BIGINT) AS units,
               CAST(SUM(total) AS DOUBLE) AS revenue,
               CAST(GROUPING(status) + GROUPING(year_of) AS BIGINT) AS level
        FROM (SELECT status, CAST(EXTRACT(YEAR FROM created_at) AS BIGINT) AS year_of,
                     COUNT(*) AS items, SUM(CAST(sale_price AS DECIMAL(18, 2))) AS total
              FROM {orders} GROUP BY 1, 2) AS yearly
        GROUP BY ROLLUP (status, year_of) ORDER BY level, status, year_of
    """,
    # Each side is made distinct before the sets meet, so a popular product is one row there too.
    "free_select_sets": """
        SELECT id, 'not returned' AS kind FROM (
            SELECT DISTINCT order_id AS id FROM {orders}
            EXCEPT
            SELECT DISTINCT order_id AS id FROM {orders} WHERE returned_at IS NOT NULL
        ) AS clean
        UNION ALL
        SELECT id, 'sold and scarce' AS kind FROM (
            SELECT DISTINCT product_id AS id FROM {orders}
            INTERSECT
            SELECT product_id AS id FROM {inventory} GROUP BY product_id
            HAVING SUM(CASE WHEN sold_at IS NULL THEN 1 ELSE 0 END) < 12
        ) AS scarce
        ORDER BY kind, id
    """,
    "free_select_exists": """
        SELECT o.status AS status, COUNT(*) AS items, COUNT(DISTINCT o.user_id) AS users
        FROM {orders} AS o
        WHERE EXISTS (SELECT 1 FROM {mg} AS p WHERE p.id_user = o.user_id)
          AND NOT EXISTS (SELECT 1 FROM {mg} AS q
                          WHERE q.id_user = o.user_id AND q.total_payout IS NULL)
        GROUP BY o.status ORDER BY status
    """,
}
