"""Records of CSV files whose quoted values hold line breaks, put together by many tasks.

Spark's own multi-line reader takes a file per task. Here the file is read as lines, split as any
text is. Two patterns tell of every line whether it ends inside a quoted field if it starts outside
of one, and if it starts inside. So a line either keeps the state, swaps it, or sets it whatever it
was; the state at any line is that of the last setting line and the swaps since. This is found
within each block of the file and carried from block to block by one small row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

# A quote opens a field only at its beginning; doubled, it stands for itself inside; after the closing quote, as in
# an unquoted field, everything up to the comma is text.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
# A whole field and the comma after it.
FIELD = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?+,)'
OPENS = rf'^{FIELD}*+"{_INSIDE}\z'
STAYS_OPEN = rf'^{_INSIDE}(?:"[^,]*+,{FIELD}*+"{_INSIDE})?+\z'


def _state_after(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """``rows (from_outside, from_inside)`` with ``after_outside`` and ``after_inside``: the state (1: inside) after each row if the
    first row of its window starts outside, and if it starts inside."""
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sets = F.col("from_outside") == F.col("from_inside")
    swaps = F.when(F.col("from_outside") > F.col("from_inside"), 1).otherwise(0)

    def after(start: int) -> Column:
        return (F.coalesce("set_to", F.lit(start)) + F.col("swaps") - F.coalesce("swaps_then", F.lit(0))) % 2

    return (
        rows.withColumn("swaps", F.sum(swaps).over(upto))
        .withColumn("set_to", F.last(F.when(sets, F.col("from_outside")), ignorenulls=True).over(upto))
        .withColumn("swaps_then", F.last(F.when(sets, F.col("swaps")), ignorenulls=True).over(upto))
        .withColumn("after_outside", after(0))
        .withColumn("after_inside", after(1))
        .drop("swaps", "set_to", "swaps_then")
    )


def read_records(spark: SparkSession, paths: Sequence[str], encoding: str) -> DataFrame:
    """``file, record_no, record``: every record's text, numbered from 1 within its file.

    Blank lines between records are left out. A quoted field that is still open at the end of its file is an error.
    """
    # The text reader hands over bytes as they are.
    text = F.decode(F.col("value").cast("binary"), encoding)
    in_block = Window.partitionBy("file", "block").orderBy("line")
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        text.alias("value"),
    )
    lines = lines.withColumn("from_outside", F.col("value").rlike(OPENS).cast("int"))
    lines = lines.withColumn("from_inside", F.col("value").rlike(STAYS_OPEN).cast("int"))
    lines = (
        _state_after(lines, in_block)
        .withColumn("before_outside", F.lag("after_outside", 1, 0).over(in_block))
        .withColumn("before_inside", F.lag("after_inside", 1, 1).over(in_block))
        .withColumn("filled", F.btrim("value", F.lit(" \t\r")) != "")
    )
    blocks = lines.groupBy("file", "block").agg(
        F.max_by("after_outside", "line").alias("from_outside"),
        F.max_by("after_inside", "line").alias("from_inside"),
        F.count_if((F.col("before_outside") == 0) & F.col("filled")).alias("starts_from_outside"),
        F.count_if((F.col("before_inside") == 0) & F.col("filled")).alias("starts_from_inside"),
    )
    # One row per block of the file's bytes in these windows.
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    message = F.concat(F.lit("a quoted CSV field is not closed: "), F.col("file"))
    left_open = F.lead("block").over(in_file).isNull() & (F.col("after_outside") == 1)
    carried = (
        _state_after(blocks, in_file)
        .withColumn("carried", F.lag("after_outside", 1, 0).over(in_file))
        .withColumn("carried", F.when(left_open, F.raise_error(message).cast("int")).otherwise(F.col("carried")))
        .withColumn("starts", F.when(F.col("carried") == 0, F.col("starts_from_outside")).otherwise(F.col("starts_from_inside")))
        .withColumn("earlier", F.coalesce(F.sum("starts").over(before), F.lit(0)))
        .select("file", "block", "carried", "earlier")
    )
    outside = F.when(F.col("carried") == 0, F.col("before_outside")).otherwise(F.col("before_inside")) == 0
    starts = (outside & F.col("filled")).cast("int")
    numbered = (
        lines.join(carried, ["file", "block"])
        .withColumn("record_no", F.col("earlier") + F.sum(starts).over(in_block))
        .where(F.col("filled") | ~outside)
    )
    # A record's lines are few; every key is one record, so no group is large.
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    return (
        numbered.groupBy("file", "record_no")
        .agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("record"))
        # The line break that ends a record may have been \r\n.
        .withColumn("record", F.regexp_replace("record", r"\r$", ""))
    )
