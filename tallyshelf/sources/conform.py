"""Header names, aliases, missing columns and types: from raw text columns to a declared table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.functions import coercion
from tallyshelf.schemas import TableSpec


def normal_headers(headers: Sequence[str | None], spec: TableSpec) -> list[str]:
    """Trimmed lower-case header names; a repeated or empty name gets a positional one.

    The first of several equal names keeps the name, so it is the one the table uses.
    """
    seen: set[str] = set()
    names = []
    for position, raw in enumerate(headers):
        name = (raw or "").strip().lower()
        if spec.spaces_to_underscore:
            name = name.replace(" ", "_")
        if not name or name in seen:
            name = f"{name}.{position}"
        seen.add(name)
        names.append(name)
    return names


def rename_headers(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.toDF(*normal_headers(df.columns, spec))


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _given(df: DataFrame, name: str) -> Column:
    """The column, with missing-value words in text as null."""
    column = F.col(f"`{name}`")
    return coercion.null_words(column) if _is_text(df, name) else column


def merge_aliases(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Alias columns folded into their canonical column: canonical first, then declared order."""
    merged_names = {*spec.aliases, *spec.aliases.values()}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in merged_names]
    merged = []
    for target in dict.fromkeys(spec.aliases.values()):
        sources = [c for c in spec.sources_of(target) if c in df.columns]
        if sources:
            merged.append(F.coalesce(*[_given(df, c) for c in sources]).alias(target))
    return df.select(*kept, *merged)


def enforce_schema(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Exactly the declared columns in order: missing ones null, extra ones dropped.

    Columns are cast to the declared type; text columns should go through ``coerce_types`` first.
    """
    present = set(df.columns)
    return df.selectExpr(*[
        f"CAST({f'`{f.name}`' if f.name in present else 'NULL'} AS {f.dataType.simpleString()})"
        f" AS `{f.name}`"
        for f in spec.schema.fields
    ])


def typed_column(df: DataFrame, name: str, spec: TableSpec, formats: Sequence[str] = ()) -> Column:
    """The column as its declared type; text is parsed, other types are only checked for NaN."""
    dtype = spec.type_of(name)
    column = F.col(f"`{name}`")
    if _is_text(df, name):
        return coercion.coerce(column, dtype, formats)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        column = coercion.nan_to_null(column)
        if isinstance(dtype, T.LongType):
            column = F.when(column == F.floor(column), column)
    return column.try_cast(dtype)


def coerce_types(df: DataFrame, spec: TableSpec, formats: Sequence[str] = ()) -> DataFrame:
    """Every declared column of ``df`` as its declared type, unfit values null; others untouched."""
    declared = set(spec.columns)
    return df.select(*[
        typed_column(df, c, spec, formats).alias(c) if c in declared else F.col(f"`{c}`")
        for c in df.columns
    ])


def coercion_failures(df: DataFrame, spec: TableSpec, formats: Sequence[str] = ()) -> DataFrame:
    """One row per declared column present: values given, and values lost to coercion.

    A missing-value word is not a value given. One pass over ``df``.
    """
    names = [c for c in spec.columns if c in df.columns]
    counts = []
    for name in names:
        given = _given(df, name)
        typed = typed_column(df, name, spec, formats)
        counts.append(F.struct(
            F.lit(name).alias("column_name"),
            F.count(given).alias("given"),
            F.count_if(given.isNotNull() & typed.isNull()).alias("failed"),
        ))
    return df.agg(F.array(*counts).alias("columns")).select(
        F.lit(spec.name).alias("table_name"), F.inline("columns")
    )


def conform(df: DataFrame, spec: TableSpec, formats: Sequence[str] = ()) -> DataFrame:
    """Raw columns with raw headers to the declared table: rename, merge, type, enforce."""
    merged = merge_aliases(rename_headers(df, spec), spec)
    return enforce_schema(coerce_types(merged, spec, formats), spec)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in every floating-point column."""
    return df.select(*[
        coercion.nan_to_null(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
