"""Monthly units over arriving orders: event-time state with a watermark, results that can be written twice, late rows counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions.calendar import month_start
from tallyshelf.functions.positions import DAY, seconds

# Fixed value: how much later than the newest item an item may arrive.
DELAY = "30 days"


@dataclass(frozen=True)
class StreamResult:
    """Units per month and product, and how many dated items with a product arrived, were counted, and came too late."""

    monthly: DataFrame
    arrived: int
    counted: int

    @property
    def late(self) -> int:
        return self.arrived - self.counted


def daily_units(orders: DataFrame, delay: str = DELAY) -> DataFrame:
    """Units per day and product of a stream of order items, as stateful counts.

    State is kept per day and product until the watermark, ``delay`` behind the newest item, has passed the day; items of days
    that it has passed are dropped. Partial counts are merged before they meet the state, so a popular product is one row per task.
    """
    dated = orders.where("created_at IS NOT NULL AND product_id IS NOT NULL")
    dated = dated.observe("arrivals", F.count(F.lit(1)).alias("arrived"))
    # A watermark needs an instant: the item's own clock, read as UTC.
    timed = dated.select(F.timestamp_seconds(seconds(F.col("created_at"))).alias("at"), "product_id").withWatermark("at", delay)
    counted = timed.groupBy(F.window("at", "1 day"), "product_id").agg(F.count("*").alias("units"))
    day = F.date_from_unix_date((F.unix_seconds("window.start") / DAY).cast("int")).cast("timestamp_ntz")
    return counted.select(day.alias("day"), "product_id", "units")


def latest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``day, product_id, units``: of each day and product the count that the latest batch has written."""
    written = spark.read.schema("day timestamp_ntz, product_id bigint, units bigint, batch bigint").parquet(folder)
    return written.groupBy("day", "product_id").agg(F.max_by("units", "batch").alias("units"))


def run_monthly_units(orders: DataFrame, folder: str, delay: str = DELAY) -> StreamResult:
    """Takes in all that has arrived of a stream of order items, and returns the units per month and product so far.

    Each batch writes the counts it has changed to its own place below ``folder/counts``; a batch that is run again after a failure writes the same place again.
    Progress and state are kept in ``folder/checkpoint``: the next call goes on there. ``arrived`` and ``counted`` are of this call.
    """
    counts = f"{folder}/counts"

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{counts}/batch={batch}")

    spark = orders.sparkSession
    before = _units(spark, counts)
    query = daily_units(orders, delay).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    arrived = sum(p.observedMetrics["arrivals"].arrived for p in query.recentProgress if "arrivals" in p.observedMetrics)
    daily = latest_counts(spark, counts)
    monthly = daily.groupBy(month_start(F.col("day")).alias("month"), "product_id").agg(F.sum("units").alias("units"))
    return StreamResult(monthly, arrived, _units(spark, counts) - before)


def _units(spark: SparkSession, counts: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(counts)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return 0
    return latest_counts(spark, counts).agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]
