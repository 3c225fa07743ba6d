from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tallyshelf.sinks import upsert

SCHEMA = "k bigint, at bigint, value string, part int"


def _batch(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA).coalesce(2)


def _apply(batch, path):
    upsert.upsert(batch, path, ["k"], "at", "part")


def _table(spark, path):
    return sorted(map(tuple, upsert.read(spark, path, spark.createDataFrame([], SCHEMA).schema).collect()))


def _files(path):
    return {
        os.path.relpath(os.path.join(folder, name), path): os.stat(os.path.join(folder, name)).st_mtime_ns
        for folder, _, names in os.walk(path) for name in names if "part=" in folder and not name.startswith(".")}


@pytest.fixture
def path(spark, tmp_path):
    place = str(tmp_path / "table")
    _apply(_batch(spark, (1, 10, "a", 1), (2, 10, "b", 1), (3, 10, "c", 2), (4, 10, "d", 3), (4, 9, "old", 3)), place)
    return place


def test_a_missing_table_is_empty(spark, tmp_path):
    assert _table(spark, str(tmp_path / "none")) == []


def test_latest_wins_and_repeating_changes_nothing(spark, path):
    batch = _batch(spark, (1, 11, "new", 1), (1, 11, "new", 1), (3, 5, "late", 2), (5, 1, "added", 4), (None, 99, "no key", 1), (2, None, "x", 1))
    wanted = [(1, 11, "new", 1), (2, 10, "b", 1), (3, 10, "c", 2), (4, 10, "d", 3), (5, 1, "added", 4)]
    for _ in range(3):
        _apply(batch, path)
        assert _table(spark, path) == wanted


def test_only_touched_partitions_are_rewritten(spark, path):
    before = _files(path)
    _apply(_batch(spark, (1, 11, "new", 1)), path)
    after = _files(path)
    same = {name for name in before if after.get(name) == before[name]}
    assert {name.split("/")[0] for name in same} == {"part=2", "part=3"}
    assert {name.split("/")[0] for name in after.keys() - same} == {"part=1"}


def test_rows_change_partition(spark, path):
    _apply(_batch(spark, (3, 11, "moved", 1), (4, 12, "nowhere", None)), path)
    assert not os.path.exists(f"{path}/part=2") and not os.path.exists(f"{path}/part=3")
    _apply(_batch(spark, (4, 13, "back", 3)), path)
    assert _table(spark, path) == [(1, 10, "a", 1), (2, 10, "b", 1), (3, 11, "moved", 1), (4, 13, "back", 3)]


def test_a_batch_that_fails_leaves_the_table(spark, path):
    before = _table(spark, path)
    failing = _batch(spark, (1, 11, "new", 1)).withColumn("value", F.when(F.col("k") == 1, F.raise_error(F.lit("lost"))).cast("string"))
    with pytest.raises(Exception, match="lost"):
        _apply(failing, path)
    assert _table(spark, path) == before
    _apply(_batch(spark, (2, 11, "next", 1)), path)
    assert _table(spark, path) == [(1, 10, "a", 1), (2, 11, "next", 1), *before[2:]]


def test_a_driver_lost_while_partitions_are_replaced(spark, path, monkeypatch):
    replace = upsert._replace

    def lost(spark, path, aside):
        for name in os.listdir(f"{path}/part=1"):
            os.remove(f"{path}/part=1/{name}")
        raise RuntimeError("driver lost")

    monkeypatch.setattr(upsert, "_replace", lost)
    with pytest.raises(RuntimeError):
        _apply(_batch(spark, (1, 11, "new", 1), (3, 11, "moved", 1)), path)
    monkeypatch.setattr(upsert, "_replace", replace)
    spark.catalog.refreshByPath(path)
    upsert.recover(spark, path)
    assert _table(spark, path) == [(1, 11, "new", 1), (2, 10, "b", 1), (3, 11, "moved", 1), (4, 10, "d", 3)]
    assert not os.path.exists(f"{path}/_pending")


def test_empty_batches(spark, path):
    before = _files(path)
    _apply(_batch(spark, (None, 1, "x", 1)), path)
    assert _files(path) == before
