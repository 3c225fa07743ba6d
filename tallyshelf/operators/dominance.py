"""A theta join by counting: for every row the rows that beat it in two measures at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.sources.scratch import stored

# Distinct pairs of values in one range of either measure, on average.
BLOCK_ROWS = 20_000
_CHUNK = 1024


def _strip(rows: DataFrame, block: str, other: str) -> DataFrame:
    """``id, n``: what each row of a range is beaten by within that range; in ranges of the high measure only by rows of earlier low ranges."""

    def count(table: pa.Table) -> pa.Table:
        low, high, weight = (table.column(c).to_numpy() for c in ("low", "high", "weight"))
        ranges = table.column(other).to_numpy()
        out = np.zeros(len(low), np.int64)
        for k in range(0, len(low), _CHUNK):
            part = slice(k, k + _CHUNK)
            beats = (low[:, None] <= low[None, part]) & (high[:, None] >= high[None, part])
            if other == "x":
                beats &= ranges[:, None] < ranges[None, part]
            out[part] = weight @ beats
        return pa.table({"id": table.column("id"), "n": pa.array(out)})

    return rows.select(block, other, "id", "low", "high", "weight").groupBy(block).applyInArrow(count, "id long, n long")


def _earlier(dealt: DataFrame, blocks: int) -> DataFrame:
    """``x, y, earlier``: for each cell of ranges the rows in cells that are earlier in both measures."""
    cells = dealt.groupBy("x", "y").agg(F.sum("weight").alias("weight"))
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    grid = dealt.sparkSession.range(blocks).select(F.col("id").cast("int").alias("x"), F.explode(numbers).alias("y"))
    before = lambda key, order: Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = grid.join(cells, ["x", "y"], "left").withColumn("above", F.sum("weight").over(before("x", "y")))
    return sums.select("x", "y", F.coalesce(F.sum("above").over(before("y", "x")), F.lit(0)).alias("earlier"))


def beaten_by(df: DataFrame, low: str, high: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``beaten_by``: how many other rows are at most as great in ``low`` and at least as great in ``high``, and not equal in both.

    Null if either measure is null; such rows beat nothing. All rows and columns stay.

    Equal rows are counted first. The distinct pairs of values are dealt to ranges of either measure, ties by the other one, so no value
    is too common for a range. What beats a row lies in its own range of ``low`` or in its own range of ``high`` (both compared
    within one task of about ``block_rows`` rows), or in a cell of earlier ranges of both: those come from running sums over the
    cells, of which there are the square of the number of ranges; take longer ranges for billions of rows.
    """
    measured = df.where(F.col(low).isNotNull() & F.col(high).isNotNull())
    pairs = measured.groupBy(F.col(low).cast("double").alias("low"), F.col(high).cast("double").alias("high")).agg(
        F.count("*").alias("weight"))
    pairs = stored(pairs.withColumn("id", F.monotonically_increasing_id()), "pairs")
    blocks = max(1, -(-pairs.count() // block_rows))
    dealt = pairs.repartitionByRange(blocks, F.asc("low"), F.desc("high")).withColumn("x", F.spark_partition_id())
    dealt = stored(dealt, "by-low")
    dealt = dealt.repartitionByRange(blocks, F.desc("high"), F.asc("low")).withColumn("y", F.spark_partition_id())
    dealt = stored(dealt, "by-both")
    near = _strip(dealt, "x", "y").union(_strip(dealt, "y", "x")).groupBy("id").agg(F.sum("n").alias("n"))
    counted = dealt.join(near, "id").join(_earlier(dealt, blocks), ["x", "y"])
    found = F.col("n") + F.col("earlier") - F.col("weight")
    first, second = _unused(df, "low"), _unused(df, "high")
    counted = counted.select(F.col("low").alias(first), F.col("high").alias(second), found.alias("beaten_by"))
    same = (df[low].cast("double") == counted[first]) & (df[high].cast("double") == counted[second])
    return df.join(counted, same, "left").drop(first, second)


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
