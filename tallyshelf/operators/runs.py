"""Runs of equal states per key, by a table function that Spark partitions and orders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.positions import DAY, bucket


def _piece_function(key_type: str, state_type: str):
    # A class made here travels to the workers by value, so they need not have this package.
    class Pieces:
        """One row per run of equal states of a key and bucket, from rows in order; holds the current run only."""

        def __init__(self):
            self.run = None
            self.number = 0

        @staticmethod
        def differs(column):
            """Whether each value but the first differs from the one before; nulls are equal."""
            if pa.types.is_nested(column.type):
                values = column.to_pylist()
                return np.array([x != y for x, y in zip(values[1:], values, strict=False)], bool)
            now, before = column.slice(1), column.slice(0, len(column) - 1)
            one_null = pc.xor(pc.is_null(now), pc.is_null(before))
            return pc.coalesce(pc.not_equal(now, before), one_null).to_numpy(zero_copy_only=False).astype(bool)

        def eval(self, batch: pa.RecordBatch):
            if not batch.num_rows:
                return
            ones = pa.array(np.ones(batch.num_rows, np.int64))
            arrays = [*[batch.column(c) for c in ("key", "bucket", "state", "at", "at")], ones]
            rows = pa.RecordBatch.from_arrays(arrays, ["key", "bucket", "state", "first_at", "last_at", "n"])
            if self.run is not None:
                rows = pa.concat_batches([self.run, rows])
            begins = self.differs(rows["key"]) | self.differs(rows["bucket"]) | self.differs(rows["state"])
            starts = np.concatenate([[0], np.flatnonzero(begins) + 1])
            ends = np.concatenate([starts[1:], [rows.num_rows]]) - 1
            counts = pa.array(np.add.reduceat(rows["n"].to_numpy(), starts))
            found = [*[rows[c].take(pa.array(starts)) for c in ("key", "bucket", "state", "first_at")], rows["last_at"].take(pa.array(ends)), counts]
            pieces = pa.RecordBatch.from_arrays(found, rows.schema.names)
            self.run = pieces.slice(len(starts) - 1)
            if len(starts) > 1:
                yield self.numbered(pieces.slice(0, len(starts) - 1))

        def terminate(self):
            if self.run is not None:
                yield self.numbered(self.run)

        def numbered(self, pieces):
            numbers = np.arange(self.number, self.number + pieces.num_rows)
            self.number += pieces.num_rows
            return pieces.add_column(2, "piece", pa.array(numbers, pa.int64()))

    return F.arrow_udtf(Pieces, returnType=(
        f"key {key_type}, bucket bigint, piece bigint, state {state_type}, first_at timestamp_ntz, last_at timestamp_ntz, n bigint"))


def state_runs(rows: DataFrame, key: str, state: str, at: str, item: str, width: int = 90 * DAY) -> DataFrame:
    """``key, run, state, run_start, run_end, items``: a key's rows in order of ``at`` and ``item``, runs of one state put together.

    ``run`` numbers a key's runs from 1; nulls are a state of their own. Rows without key, time or item are left out; rows that agree in ``at`` and
    ``item`` follow in order of state.

    The table function sees the rows of many keys and buckets of ``width`` seconds, each in order and by Arrow batches, and keeps one run, so memory does
    not depend on the rows. A bucket may hold a row or two: there is no call per bucket. A popular key is dealt by its buckets; only its pieces, at least
    one state change or bucket apart, meet in one window.
    """
    known = rows.select(
        F.col(key).alias("key"), F.col(state).alias("state"), F.col(at).alias("at"), F.col(item).cast("bigint").alias("item"),
    ).dropna(subset=["key", "at", "item"]).withColumn("bucket", bucket(F.col("at"), width))
    types = dict(known.dtypes)
    # Each task's function reads one partition of this table, as it is ordered here.
    dealt = known.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "at", "item", "state")
    pieces = _piece_function(types["key"], types["state"])(dealt.asTable())
    in_order = Window.partitionBy("key").orderBy("bucket", "piece")
    begins = F.lag("n").over(in_order).isNull() | ~F.col("state").eqNullSafe(F.lag("state").over(in_order))
    numbered = pieces.withColumn("begins", begins.cast("bigint"))
    numbered = numbered.withColumn("run", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("key", "run", "state").agg(
        F.min("first_at").alias("run_start"), F.max("last_at").alias("run_end"), F.sum("n").alias("items"))
    return runs.select(F.col("key").alias(key), "run", F.col("state").alias(state), "run_start", "run_end", "items")
