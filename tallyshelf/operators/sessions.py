"""Sessions: runs of a user's events with no gap longer than given, put together from pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.positions import DAY, bucket

# Fixed value: seconds without an event that end a session.
GAP = 1800


def user_sessions(events: DataFrame, gap: int = GAP, width: int = DAY) -> DataFrame:
    """``user_id, session, session_start, session_end, events, purchases, value`` from ``events (user_id, ts, event_type, value)``.

    An event more than ``gap`` seconds after the one before it begins a session; ``session`` numbers a user's sessions from 1. Events
    without a user or time are left out, missing values count as nothing.

    Events are first put together within buckets of ``width`` seconds of a user, then these pieces across buckets: a user with very many events
    is as many tasks as there are buckets, and only its pieces meet in one.
    """
    limit = F.make_dt_interval(secs=F.lit(gap).cast("decimal(18,6)"))
    known = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select(
        "user_id", "ts", bucket(F.col("ts"), width).alias("bucket"), (F.col("event_type") == "purchase").cast("int").alias("bought"),
        F.col("value").cast("decimal(18,2)").alias("value"))
    in_bucket = Window.partitionBy("user_id", "bucket").orderBy("ts")
    new = F.col("ts") > F.lag("ts").over(in_bucket) + limit
    numbered = known.withColumn("new", F.coalesce(new, F.lit(False)).cast("int"))
    numbered = numbered.withColumn("piece", F.sum("new").over(in_bucket.rangeBetween(Window.unboundedPreceding, 0)))
    sums = [F.sum(c).alias(c) for c in ("events", "purchases", "total")]
    pieces = numbered.groupBy("user_id", "bucket", "piece").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"),
        F.coalesce(F.sum("bought"), F.lit(0)).alias("purchases"), F.sum("value").alias("total"))
    of_user = Window.partitionBy("user_id").orderBy("first")
    begins = F.coalesce(F.col("first") > F.lag("last").over(of_user) + limit, F.lit(True))
    pieces = pieces.withColumn("begins", begins.cast("bigint"))
    pieces = pieces.withColumn("session", F.sum("begins").over(of_user.rowsBetween(Window.unboundedPreceding, 0)))
    return pieces.groupBy("user_id", "session").agg(
        F.min("first").alias("session_start"), F.max("last").alias("session_end"), *sums[:2], F.sum("total").cast("double").alias("value"))
