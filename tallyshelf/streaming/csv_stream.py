"""CSV exports that keep arriving in a folder, as an unbounded declared table.

Re-reading all files for every question is what a stream of new files replaces: each file is read
once, by the same rules as a batch load. All of them look at one row at a time, so the stream
keeps no state and needs no watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.schemas import TableSpec
from tallyshelf.sources import conform
from tallyshelf.sources.csv_tables import UTF8, reader_options, shape_rows, text_schema


def stream_table(
    spark: SparkSession,
    spec: TableSpec,
    folder: str,
    headers: Sequence[str],
    *,
    formats: Sequence[str] = (),
    encoding: str = UTF8,
    multiline: bool = False,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A streaming DataFrame of ``spec`` over the files of ``folder``, rows too wide left out.

    ``headers`` are the files' header names: a stream cannot look ahead to find them. A file with
    other headers stops the stream.
    """
    schema, plain = text_schema(list(headers))
    reader = spark.readStream.schema(schema).options(**reader_options(encoding, multiline, plain))
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    shaped = shape_rows(reader.csv(folder), list(headers), spec)
    return conform.conform(shaped.where(~F.col("too_wide")).drop("too_wide"), spec, formats)
