"""Column manifest, table shapes, sample values and previews."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.functions.ordering import take

# Characters kept of a sample value, and rows of a preview.
MANIFEST_SAMPLE_CHARS = 40
SUGGESTION_SAMPLE_CHARS = 80
PREVIEW_ROWS = 50


def _sample(field: T.StructField, chars: int, no_sample: Collection[type]) -> str:
    """A value that does not depend on row order: the smallest, as text, cut to ``chars``; of doubles to six decimals."""
    if isinstance(field.dataType, tuple(no_sample)):
        return "CAST(NULL AS STRING)"
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        text = f"CAST(try_cast(min(`{field.name}`) AS DECIMAL(38,6)) AS STRING)"
        return f"substring(regexp_replace({text}, '0{{1,5}}$', ''), 1, {chars})"
    if isinstance(field.dataType, T.StringType):
        # The prefix of the smallest text is the smallest prefix; long texts stay out of buffers.
        return f"min(substring(`{field.name}`, 1, {chars}))"
    if isinstance(field.dataType, T.TimestampNTZType):
        return f"date_format(min(`{field.name}`), 'yyyy-MM-dd HH:mm:ss')"
    return f"substring(CAST(min(`{field.name}`) AS STRING), 1, {chars})"


def _manifest_of(name: str, df: DataFrame, chars: int, no_sample: Collection[type]) -> DataFrame:
    entries = ", ".join(
        f"named_struct('column_name', '{f.name}', 'position', {position}L, "
        f"'data_type', '{f.dataType.simpleString()}', "
        f"'has_nulls', coalesce(bool_or(`{f.name}` IS NULL), FALSE), "
        f"'sample', {_sample(f, chars, no_sample)})"
        for position, f in enumerate(df.schema.fields, start=1)
    )
    return df.agg(F.expr(f"array({entries})").alias("columns")).select(
        F.lit(name).alias("table_name"), F.inline("columns")
    )


def column_manifest(
    tables: dict[str, DataFrame], chars: int = MANIFEST_SAMPLE_CHARS, no_sample: Collection[type] = ()
) -> DataFrame:
    """Per table and column: type, whether nulls occur, and a sample. One pass per table.

    Columns of the ``no_sample`` types get a null sample.
    """
    parts = [_manifest_of(name, df, chars, no_sample) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def column_samples(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, sample`` as used beside column suggestions."""
    manifest = column_manifest(tables, SUGGESTION_SAMPLE_CHARS)
    return manifest.select("table_name", "column_name", "sample")


def table_shapes(tables: dict[str, DataFrame], as_many: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows and columns per table; rows are counted in ``as_many`` where that names a cheaper table with as many."""
    parts = [
        (as_many or {}).get(name, df).agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def preview(df: DataFrame, keys: list[Column], n: int = PREVIEW_ROWS, as_many: DataFrame | None = None) -> DataFrame:
    """The first ``n`` rows by ``keys``, each with the row count of the whole result.

    An empty result gives no rows. ``as_many`` is a cheaper table with as many rows, if there is one.
    """
    total = (df if as_many is None else as_many).agg(F.count("*")).scalar()
    return take(df, keys, n).withColumn("total_rows", total)
