from __future__ import annotations

import os

from tallyshelf.sources.scratch import discard, stored


def test_discard_removes_stored_tables_only(spark):
    first, second = stored(spark.range(5).toDF("n"), "first"), stored(spark.range(3).toDF("n"), "second")
    folders = [table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for table in (first, second)]
    assert all(map(os.path.isdir, folders))
    discard(first, spark.range(2).toDF("n"))
    assert [os.path.isdir(folder) for folder in folders] == [False, True]
    discard(first)
    assert second.count() == 3


def test_stored_tables_leave_the_setting_as_it_was(spark):
    from tallyshelf.sources import scratch

    before = spark.conf.get(scratch._CLEANUP)
    table = scratch.stored(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "test")
    assert sorted(map(tuple, table.collect())) == [(k, 1000 // 7 + (k < 1000 % 7)) for k in range(7)]
    assert spark.conf.get(scratch._CLEANUP) == before
    scratch.discard(table)
