"""Jobs over logs of questions and of SQL replies; pure column expressions, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.operators.payouts import PAYOUT_ROWS
from tallyshelf.operators.sales import BY_VALUE_ROWS
from tallyshelf.operators.stock import LOW_STOCK, REPORT_ROWS, TOP_SOLD_ROWS

# Words and patterns that decide what a question asks for.
CUSTOMER_PHRASE = "total customer"
PAYOUT_PATTERN = r"minimum guarantee|\bmg\b|logistics"
INVENTORY_WORDS = [
    "inventory", "stockout", "stock out", "overstock", "on hand", "reorder",
    "slow-moving", "slow moving",
]
MONTHLY_WORDS = ["month", "monthly"]
TOP_SOLD_WORDS = [
    "most sold", "top sold", "best seller", "bestseller", "most selling", "top sales",
    "top sold items",
]
REORDER_WORDS = ["reorder", "low stock", "low inventory", "stockout", "stock out"]
SLOW_WORDS = ["slow", "overstock"]
DESCENDING_WORDS = ["decreas", "desc", "descending", "highest"]
TOP_N_PATTERN = r"\btop\s+(\d+)\b"
ORDER_LIMIT_PATTERN = r"\b(top|first|limit|give me|show me)\s*(\d+)"
THRESHOLD_PATTERN = r"(threshold|below|less than)\s+(\d+)"

# Decorations around a SQL reply.
REPLY_DECORATIONS = [
    "```sql", "```", "Here is the SQL:", "Here’s the SQL:", "Here is the query:", "SQL:", "Query:",
]

# From where a query starts to the end; prose may say "with", a WITH clause names a query.
_NAMED = r"""with\s+(?:recursive\s+)?(?:\w+|"[^"]+"|`[^`]+`)\s*(?:\([^()]*\)\s*)?as\s*(?:(?:not\s+)?materialized\s*)?\("""
_QUERY = rf"(?is)(?:\bselect\b|\b{_NAMED}).*"
_WHITESPACE = " \t\n\r\f\v"


def _any_word(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def _number(text: Column, pattern: str, group: int, default: int) -> Column:
    """The captured number, the default without one, the largest BIGINT when it is larger."""
    digits = F.regexp_extract(text, pattern, group)
    largest = F.lit(2**63 - 1)
    return F.when(digits == "", F.lit(default).cast("bigint")).otherwise(
        F.coalesce(digits.try_cast("bigint"), largest)
    )


def route_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds ``route, sub_route, row_limit, threshold`` to every question.

    Routes are tried in a fixed order: total customers, payouts, inventory, orders by value. The
    inventory route has a sub-route, ``monthly`` whenever a month is mentioned. ``row_limit`` and
    ``threshold`` are null where the report has none.
    """
    q = F.lower(F.coalesce(F.col(text), F.lit("")))
    by_value = q.contains("orders") & q.contains("value") & _any_word(q, DESCENDING_WORDS)
    route = (
        F.when(q.contains(CUSTOMER_PHRASE), "total_customers")
        .when(q.rlike(PAYOUT_PATTERN), "payouts")
        .when(_any_word(q, INVENTORY_WORDS), "inventory")
        .when(by_value, "orders_by_value")
        .otherwise("none")
    )
    sub_route = F.when(
        F.col("route") == "inventory",
        F.when(_any_word(q, MONTHLY_WORDS), "monthly")
        .when(_any_word(q, TOP_SOLD_WORDS), "top_sold")
        .when(_any_word(q, REORDER_WORDS), "reorder")
        .when(_any_word(q, SLOW_WORDS), "slow")
        .otherwise("overview"),
    )
    row_limit = (
        F.when(F.col("route") == "payouts", PAYOUT_ROWS)
        .when(F.col("route") == "orders_by_value",
              _number(q, ORDER_LIMIT_PATTERN, 2, BY_VALUE_ROWS))
        .when(F.col("sub_route") == "top_sold", _number(q, TOP_N_PATTERN, 1, TOP_SOLD_ROWS))
        .when(F.col("sub_route").isin("reorder", "slow", "overview"), REPORT_ROWS)
    )
    threshold = F.when(
        F.col("sub_route").isin("reorder", "slow"), _number(q, THRESHOLD_PATTERN, 2, LOW_STOCK)
    )
    return (
        questions.withColumn("route", route)
        .withColumn("sub_route", sub_route)
        .withColumns({"row_limit": row_limit.cast("bigint"), "threshold": threshold})
    )


def clean_sql(reply: Column) -> Column:
    """The first query in a model's reply, or an empty string.

    Fences and lead-ins go, then everything before the query, then comments; of the parts between
    semicolons the first that is a query is kept. A query starts with SELECT or with a WITH clause.
    Comment markers inside string literals count as comments.
    """
    text = F.coalesce(reply, F.lit(""))
    for words in REPLY_DECORATIONS:
        text = F.replace(text, F.lit(words), F.lit(""))
    query = F.regexp_extract(text, _QUERY, 0)
    query = F.regexp_replace(query, r"--[^\n]*", "")
    query = F.regexp_replace(query, r"(?s)/\*.*?\*/", "")
    queries = F.filter(F.split(query, ";"), lambda part: part.rlike(r"(?i)^\s*(select|with)"))
    return F.coalesce(F.btrim(F.get(queries, F.lit(0)), F.lit(_WHITESPACE)), F.lit(""))


def clean_sql_log(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Adds ``sql``, the cleaned query of every reply."""
    return replies.withColumn("sql", clean_sql(F.col(text)))
