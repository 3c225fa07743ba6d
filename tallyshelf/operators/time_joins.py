"""Joins by time: the latest earlier row, and intervals that hold a point or overlap.

None compares rows pair by pair within a key. Rows of a key are split by time buckets, so one popular key is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.positions import DAY, bucket, seconds

# Seconds of the smallest interval buckets; each level has buckets four times as long, as a point is multiplied by the levels.
SMALLEST, LONGER = 3600, 4


def asof_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str,
    take: dict[str, str], width: int = DAY, strict: bool = False,
) -> DataFrame:
    """``left`` with columns of the latest row of ``right`` that has the same ``on`` and is not later (with ``strict``: earlier).

    ``take`` names the new columns: ``{new name: column of right}``. Every left row stays once; the new columns are null where there is no
    such row, or a key or the time is null. Of right rows at the same time the greatest by the taken columns in order counts.

    Both tables become one stream of rows per key and bucket of ``width`` seconds. Within a bucket the last right row is carried
    along in order of time; across buckets only one right row per bucket is. A popular key is as many tasks as it has buckets.
    """
    names = list(on)
    full = lambda time: " AND ".join(f"`{c}` IS NOT NULL" for c in (*names, time))
    value = F.struct(*[F.col(c).alias(new) for new, c in take.items()])
    # A left row carries what its key and time do not say already; where the tables' types differ, they may be widened.
    said = {c: F.col(f"key{k}") for k, c in enumerate(names) if left.schema[c].dataType == right.schema[c].dataType}
    if left.schema[left_time].dataType == right.schema[right_time].dataType:
        said[left_time] = F.col("at")
    rest = [c for c in left.columns if c not in said]
    here = left.select(
        *[F.col(c).alias(f"key{k}") for k, c in enumerate(names)], F.col(left_time).alias("at"),
        F.struct(*(rest or [F.lit(True).alias("asks")])).alias("row"))
    keys = [f"key{k}" for k in range(len(names))]
    timed = " AND ".join(f"{c} IS NOT NULL" for c in (*keys, "at"))
    theirs = right.where(full(right_time)).select(
        *[F.col(c).alias(k) for c, k in zip(names, keys, strict=True)], F.col(right_time).alias("at"), value.alias("value"))
    lefts = here.where(timed).withColumns({"value": F.lit(None).cast(theirs.schema["value"].dataType), "order": F.lit(0 if strict else 1)})
    rights = theirs.withColumns({"row": F.lit(None).cast(here.schema["row"].dataType), "order": F.lit(1 if strict else 0)})
    stream = lefts.unionByName(rights).withColumn("bucket", bucket(F.col("at"), width))
    so_far = Window.partitionBy(*keys, "bucket").orderBy("at", "order", "value").rowsBetween(Window.unboundedPreceding, 0)
    carried = stream.withColumn("found", F.last("value", ignorenulls=True).over(so_far)).where("row IS NOT NULL")
    latest = F.max(F.when(F.col("value").isNotNull(), F.struct("at", "value")))["value"]
    ends = stream.groupBy(*keys, "bucket").agg(latest.alias("latest"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "bucket", F.last("latest", ignorenulls=True).over(before).alias("before"))
    joined = carried.join(ends.where("before IS NOT NULL"), [*keys, "bucket"], "left")
    joined = joined.select(*keys, "at", "row", F.coalesce("found", "before").alias("found"))
    untimed = here.where(f"NOT ({timed})").withColumn("found", F.lit(None).cast(theirs.schema["value"].dataType))
    own = [said[c].alias(c) if c in said else F.col(f"row.{c}") for c in left.columns]
    return joined.union(untimed).select(*own, *[F.col(f"found.{new}").alias(new) for new in take])


def _level(start: Column, end: Column) -> Column:
    """The first level whose buckets are at least as long as the interval."""
    length = F.greatest(seconds(end) - seconds(start), F.lit(1))
    return F.greatest(F.ceil(F.log2(length / SMALLEST) / math.log2(LONGER)), F.lit(0)).cast("int")


def _width(level: Column) -> Column:
    return (F.lit(SMALLEST) * F.pow(F.lit(LONGER), level)).cast("bigint")


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, on: Sequence[str], at: str, start: str, end: str, strict: bool = False
) -> DataFrame:
    """All columns of both tables for every point and interval of equal ``on`` with ``start <= at < end`` (``strict``: ``start < at``).

    Besides ``on`` the tables share no column name. Null keys and times, and intervals that end before they begin or at once, meet nothing.

    An interval lies in the at most three buckets of the first level whose buckets are as long as itself; a point in one bucket of each level
    that occurs. So a long interval is not cut into many pieces, a pair meets in exactly one bucket, and a popular key is split by time.

    Spark estimates both sides as small as before their rows were multiplied, so it would broadcast millions of rows: they are merged instead.
    """
    names = list(on)
    spans = intervals.where(f"`{start}` < `{end}`").withColumn("level", _level(F.col(start), F.col(end)))
    levels = spans.agg(F.collect_set("level")).scalar()  # some fifteen at most
    wide = _width(F.col("level"))
    covered = F.sequence(bucket(F.col(start), wide), bucket(F.col(end), wide))
    spans = spans.withColumn("bucket", F.explode(covered))
    probes = points.where(F.col(at).isNotNull()).withColumn("level", F.explode(levels))
    probes = probes.withColumn("bucket", bucket(F.col(at), wide))
    met = probes.hint("merge").join(spans, [*names, "level", "bucket"])
    inside = (F.col(start) < F.col(at)) if strict else (F.col(start) <= F.col(at))
    return met.where(inside & (F.col(at) < F.col(end))).drop("level", "bucket")


def overlapping(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str]
) -> DataFrame:
    """All columns of both tables for every pair of intervals ``[start, end)`` of equal ``on`` that have an instant in common, once each.

    Of two overlapping intervals one begins in the other: either the right one does, or the left one does and begins later. Besides
    ``on`` the tables share no column name; empty intervals and nulls meet nothing.
    """
    left, right = left.where(f"`{left_span[0]}` < `{left_span[1]}`"), right.where(f"`{right_span[0]}` < `{right_span[1]}`")
    right_begins = points_in_intervals(right, left, on, right_span[0], *left_span)
    left_begins = points_in_intervals(left, right, on, left_span[0], *right_span, strict=True)
    return right_begins.unionByName(left_begins)
