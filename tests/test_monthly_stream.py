"""Monthly units over a stream: equal to the batch but for late rows, which are counted, and writable twice."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tallyshelf.sources.scratch import fresh_path
from tallyshelf.streaming import monthly
from workload import inputs

SCHEMA = "product_id long, created_at timestamp_ntz"


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def units(result):
    return {(str(r.month)[:7], r.product_id): r.units for r in result.monthly.collect()}


def day(text):
    return dt.datetime.fromisoformat(text)


def test_late_rows_are_counted_and_a_later_call_goes_on(spark):
    arrivals, out = fresh_path(spark, "arrivals"), fresh_path(spark, "out")
    arrive(spark, arrivals, [(1, day("2024-01-05T23:59:59")), (1, day("2024-01-20")), (2, day("2024-02-10")), (None, day("2024-02-10")), (3, None)])
    arrive(spark, arrivals, [(1, day("2024-01-25")), (2, day("2024-04-01")), (2, day("2024-04-01T01:00:00"))])  # the first is within 30 days
    arrive(spark, arrivals, [(1, day("2024-01-06")), (1, day("2024-01-06")), (2, day("2024-03-31"))])  # two are too late by now
    first = monthly.run_monthly_units(stream(spark, arrivals), out)
    assert units(first) == {("2024-01", 1): 3, ("2024-02", 2): 1, ("2024-03", 2): 1, ("2024-04", 2): 2}
    assert (first.arrived, first.counted, first.late) == (9, 7, 2)
    arrive(spark, arrivals, [(2, day("2024-04-02")), (1, day("2024-01-07"))])
    second = monthly.run_monthly_units(stream(spark, arrivals), out)
    assert units(second)["2024-04", 2] == 3 and units(second)["2024-01", 1] == 3
    assert (second.arrived, second.counted, second.late) == (2, 1, 1)


def test_equals_the_batch_and_a_repeated_batch_changes_nothing(spark):
    arrivals, out = fresh_path(spark, "arrivals"), fresh_path(spark, "out")
    rows = [(k % 5, day("2024-01-01") + dt.timedelta(hours=7 * k)) for k in range(400)]
    for k in range(0, 400, 100):
        arrive(spark, arrivals, rows[k : k + 100])
    result = monthly.run_monthly_units(stream(spark, arrivals), out)
    expected = Counter((t.isoformat()[:7], p) for p, t in rows)
    assert units(result) == dict(expected) and result.late == 0
    # What a batch wrote is written again, as after a failure of the driver between the write and the commit.
    last = max(r.batch for r in spark.read.parquet(f"{out}/counts").select("batch").distinct().collect())
    again = [tuple(r) for r in spark.read.parquet(f"{out}/counts/batch={last}").collect()]
    fields = "day timestamp_ntz, product_id long, units long"
    spark.createDataFrame(again, fields).write.mode("overwrite").parquet(f"{out}/counts/batch={last}")
    daily = monthly.latest_counts(spark, f"{out}/counts")
    assert daily.agg(F.sum("units")).first()[0] == 400


def test_state_and_watermark_are_in_the_plan(spark):
    arrivals = fresh_path(spark, "arrivals")
    arrive(spark, arrivals, [(1, day("2024-01-05"))])
    plan = monthly.daily_units(stream(spark, arrivals))._jdf.queryExecution().logical().toString()
    assert "EventTimeWatermark" in plan and "window" in plan


def test_one_task_writes_a_year_but_joins_none(spark, folder, monkeypatch):
    plans, write = {}, DataFrameWriter.parquet

    def noted(writer, path, *more, **options):
        plans.setdefault(path, []).append(writer._df._jdf.queryExecution().executedPlan().toString())
        return write(writer, path, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    path = inputs.arriving_orders(spark, folder)
    assert len(plans[path]) > 2
    for plan in plans[path]:
        assert "Coalesce" not in plan and "Join" not in plan and "SinglePartition" in plan
    files = spark.read.schema(inputs.ARRIVING).parquet(path).groupBy(F.input_file_name()).count().count()
    assert files == len(plans[path])
