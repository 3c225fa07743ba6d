"""Column references in logged SQL: which are not in the schema, and what may have been meant."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.schemas import TABLES, TableSpec

# The letters that stand for the tables, and the rule for suggestions.
DEFAULT_ALIASES = {
    "i": "inventory", "inventory": "inventory",
    "o": "orders", "orders": "orders",
    "m": "mg", "mg": "mg",
}
MAX_SUGGESTIONS = 5
MIN_SIMILARITY = 0.6

# Words that may follow a relation name without being its alias.
_NOT_AN_ALIAS = (
    "on|using|where|group|order|having|limit|offset|join|inner|left|right|full|outer|cross|natural"
    "|semi|anti|union|intersect|except|qualify|window|select|lateral|tablesample"
)
_RELATION = rf"\b(?:from|join)\s+(\w+)(?:\s+(?:as\s+)?(?!(?:{_NOT_AN_ALIAS})\b)(\w+))?"
_REFERENCE = r"\b\w+\.\w+\b"


def _text(value: str) -> str:
    return f"'{value}'"


def _usual_tables() -> Column:
    """A constant map from the usual letters and names to tables."""
    pairs = [_text(word) for pair in DEFAULT_ALIASES.items() for word in pair]
    return F.expr(f"map({', '.join(pairs)})")


def _known_names() -> Column:
    """A constant array of every ``table.column``."""
    names = [_text(f"{t}.{c}") for t, spec in TABLES.items() for c in spec.columns]
    return F.expr(f"array({', '.join(names)})")


def _meant(reference: Column) -> Column:
    """``table.column`` of a reference; its qualifier is an alias of this query first, then a
    relation of it, then one of the usual letters, else nothing."""
    qualifier = F.substring_index(reference, ".", 1)
    aliased = F.try_element_at("relations", F.nullif(
        F.array_position("aliases", qualifier).cast("int"), F.lit(0)))
    named = F.when(F.array_contains("relations", qualifier), qualifier)
    usual = F.try_element_at(_usual_tables(), qualifier)
    column = F.substring_index(reference, ".", -1)
    return F.concat(F.coalesce(aliased, named, usual), F.lit("."), column)


def audit_columns(log: DataFrame, query_id: str = "query_id", sql: str = "sql") -> DataFrame:
    """``query_id, table_name, column_name`` for every qualified column the schema lacks.

    Each query's relations decide what an alias means, so a CTE named ``m`` is not taken for a
    table. Unqualified names are not checked. Names are compared and reported in lower case. Every
    query is handled within its own row: no join, no shuffle.
    """
    text = F.lower(F.col(sql))
    parsed = log.select(
        F.col(query_id),
        F.regexp_extract_all(text, F.lit(_RELATION), F.lit(1)).alias("relations"),
        F.regexp_extract_all(text, F.lit(_RELATION), F.lit(2)).alias("aliases"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))).alias("refs"),
    )
    # array_except also removes repeats.
    missing = F.array_except(F.transform("refs", _meant), _known_names())
    return (
        parsed.select(F.col(query_id), F.explode(missing).alias("name"))
        .select(
            query_id,
            F.substring_index("name", ".", 1).alias("table_name"),
            F.substring_index("name", ".", -1).alias("column_name"),
        )
        .where(F.col("table_name").isin(list(TABLES)))
    )


def _candidates() -> Column:
    """A constant map from table to its columns: position, synonyms, place in the synonym list."""
    def entry(spec: TableSpec, position: int, column: str) -> str:
        order = list(spec.synonyms)
        place = order.index(column) + 1 if column in order else "NULL"
        synonyms = ", ".join(_text(s) for s in spec.synonyms.get(column, []))
        return (
            f"named_struct('candidate', '{column}', 'position', {position}, "
            f"'synonyms', CAST(array({synonyms}) AS ARRAY<STRING>), 'place', CAST({place} AS INT))"
        )

    tables = [
        f"'{name}', array({', '.join(entry(spec, i, c) for i, c in enumerate(spec.columns, 1))})"
        for name, spec in TABLES.items()
    ]
    return F.expr(f"map({', '.join(tables)})")


def gestalt_ratio(candidate: Column, word: Column) -> Column:
    """The standard library's matching-blocks ratio, over distinct pairs of short names."""

    # A local function travels to the workers by value, so they need not have this package.
    def ratios(candidates: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, c, w).ratio() for c, w in zip(candidates, words)])

    return F.pandas_udf(ratios, T.DoubleType())(candidate, word)


def levenshtein_ratio(candidate: Column, word: Column) -> Column:
    """One minus the edit distance over the longer length."""
    longer = F.greatest(F.length(candidate), F.length(word))
    return F.lit(1.0) - F.levenshtein(candidate, word) / longer


def suggest_columns(
    missing: DataFrame, samples: DataFrame | None = None, similarity: str = "levenshtein"
) -> DataFrame:
    """At most five columns that each missing ``table_name, column_name`` may have meant.

    Synonyms first, then names containing one another, then similar names (ratio of at least
    0.6, the five best), without repeats. ``similarity`` is ``levenshtein`` (built in)
    or ``gestalt`` (an Arrow UDF). ``samples`` adds an example value per suggested column.

    Only distinct names are compared, each with the at most 25 columns of its table.
    """
    names = missing.select(
        F.lower(F.trim("table_name")).alias("table_name"),
        F.lower(F.trim("column_name")).alias("column_name"),
    ).distinct()
    columns = F.try_element_at(_candidates(), F.col("table_name"))
    pairs = names.select("table_name", "column_name", F.inline(columns))
    word, candidate = F.col("column_name"), F.col("candidate")
    if similarity == "gestalt":
        ratio = gestalt_ratio(candidate, word)
    elif similarity == "levenshtein":
        ratio = levenshtein_ratio(candidate, word)
    else:
        raise ValueError(f"unknown similarity {similarity!r}")

    per_name = Window.partitionBy("table_name", "column_name")
    best = per_name.orderBy(F.desc_nulls_last("near"), F.desc("candidate"))
    ranked = (
        pairs.withColumn("ratio", ratio)
        .withColumn("near", F.when(F.col("ratio") >= MIN_SIMILARITY, F.col("ratio")))
        .withColumn("near_rank", F.row_number().over(best))
    )
    synonym = F.col("place").isNotNull() & (
        (word == candidate) | F.array_contains("synonyms", word)
    )
    similar = F.col("near").isNotNull() & (F.col("near_rank") <= MAX_SUGGESTIONS)
    contained = candidate.contains(word) | word.contains(candidate)
    order = (
        F.when(synonym, F.struct(F.lit(1).alias("reason"), F.col("place").alias("at")))
        .when(contained, F.struct(F.lit(2).alias("reason"), F.col("position").alias("at")))
        .when(similar, F.struct(F.lit(3).alias("reason"), F.col("near_rank").alias("at")))
    )
    chosen = (
        ranked.withColumn("order", order)
        .where(F.col("order").isNotNull())
        .withColumn("rank", F.row_number().over(per_name.orderBy("order")))
        .where(F.col("rank") <= MAX_SUGGESTIONS)
        .select(
            "table_name", "column_name",
            F.col("rank").cast("bigint").alias("rank"),
            F.col("candidate").alias("suggestion"),
        )
    )
    if samples is None:
        return chosen
    examples = samples.select("table_name", F.col("column_name").alias("suggestion"), "sample")
    # One row per declared column, so broadcasting is safe at any table size.
    return chosen.join(F.broadcast(examples), ["table_name", "suggestion"], "left").select(
        "table_name", "column_name", "rank", "suggestion", "sample"
    )
