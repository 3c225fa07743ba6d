"""Joins by time, sessions and dominance against trying every pair."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import dominance, sessions, time_joins

START = dt.datetime(2024, 3, 9, 22)


def moments(pick, n, hours, null=0.05):
    return [None if pick.random() < null else START + dt.timedelta(minutes=pick.randrange(0, hours * 60, 7)) for _ in range(n)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("width", [600, 86_400])
def test_asof_join(spark, strict, width):
    pick = random.Random(width)
    key = lambda: pick.choice([1, 1, 1, 2, 3, None])
    left = [(k, key(), t, "x") for k, t in enumerate(moments(pick, 150, 200))]
    left.append(left[3])
    right = [(key(), t, pick.choice([None, 1.5, 2.5])) for t in moments(pick, 120, 200)]
    lefts = spark.createDataFrame(left, "id long, k long, t timestamp_ntz, bucket string")
    rights = spark.createDataFrame(right, "k long, t timestamp_ntz, value double")
    found = time_joins.asof_join(lefts, rights, ["k"], "t", "t", {"price": "value", "priced": "t"}, width, strict)
    assert found.columns == ["id", "k", "t", "bucket", "price", "priced"]

    def latest(k, t):
        rows = [(rt, v is not None, v) for rk, rt, v in right if rk is not None and rk == k and rt is not None and t is not None and (rt < t if strict else rt <= t)]
        best = max(rows, key=lambda r: (r[0], r[1], r[2] or 0), default=(None, None, None))
        return best[2], best[0]

    rows = sorted((tuple(r) for r in found.collect()), key=str)
    assert rows == sorted(((*r, *latest(r[1], r[2])) for r in left), key=str)


def test_asof_join_of_empty_tables(spark):
    rows = spark.createDataFrame([(1, START)], "k long, t timestamp_ntz")
    empty = rows.limit(0)
    assert [tuple(r) for r in time_joins.asof_join(rows, empty, ["k"], "t", "t", {"at": "t"}).collect()] == [(1, START, None)]
    assert time_joins.asof_join(empty, rows, ["k"], "t", "t", {"at": "t"}).collect() == []


def test_a_popular_key_is_spread_over_its_buckets(spark):
    rows = spark.range(10).select(F.lit(1).alias("k"), F.lit(START).cast("timestamp_ntz").alias("t"))
    plan = plan_of(time_joins.asof_join(rows, rows, ["k"], "t", "t", {"at": "t"}))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "hashpartitioning(key0" in plan and plan.count("bucket") > 3
    assert "specifiedwindowframe(RowFrame, unboundedpreceding$(), currentrow$())" in plan


def test_asof_join_moves_keys_and_times_once(spark):
    rows = spark.createDataFrame([(7, 1, START)], "id long, k long, t timestamp_ntz")
    plan = time_joins.asof_join(rows, rows, ["k"], "t", "t", {"at": "t"})._jdf.queryExecution().analyzed().toString()
    assert re.findall(r"(?:named_)?struct\((id, id#[^)]*)\) AS row", plan)
    assert not re.search(r"struct\(id, [^)]*\bk#", plan)


def test_asof_join_keeps_the_left_types(spark):
    left = spark.createDataFrame([(2**24 + 1, dt.date(2024, 3, 10)), (None, None)], "k int, t date")
    right = spark.createDataFrame([(2**24 + 1, START)], "k long, t timestamp_ntz")
    found = time_joins.asof_join(left, right, ["k"], "t", "t", {"at": "t"})
    assert dict(found.dtypes) == {"k": "int", "t": "date", "at": "timestamp_ntz"}
    assert sorted(map(tuple, found.collect()), key=str) == [(2**24 + 1, dt.date(2024, 3, 10), START), (None, None, None)]


def spans(pick, n, hours):
    out = []
    for start in moments(pick, n, hours):
        length = pick.choice([None, -30, 0, 7, 60, 61, 24 * 60, 3000, 100_000])
        out.append((start, None if start is None or length is None else start + dt.timedelta(minutes=length)))
    return out


def test_points_and_overlaps(spark):
    pick = random.Random(2)
    key = lambda: pick.choice([1, 1, 2, None])
    points = [(k, key(), t) for k, t in enumerate(moments(pick, 120, 400))]
    one = [(k, key(), *s) for k, s in enumerate(spans(pick, 100, 400))]
    two = [(k, key(), *s) for k, s in enumerate(spans(pick, 100, 400))]
    at = spark.createDataFrame(points, "p long, k long, at timestamp_ntz")
    left = spark.createDataFrame(one, "a long, k long, s timestamp_ntz, e timestamp_ntz")
    right = spark.createDataFrame(two, "b long, k long, s2 timestamp_ntz, e2 timestamp_ntz")
    held = lambda x: x[1] is not None and x[2] is not None and x[3] is not None and x[2] < x[3]
    for strict in (False, True):
        found = time_joins.points_in_intervals(at, left, ["k"], "at", "s", "e", strict)
        assert "NestedLoop" not in plan_of(found)
        expected = sorted((p, a) for p, k, t in points for a, j, s, e in one
                          if held((a, j, s, e)) and j == k and t is not None and (s < t if strict else s <= t) and t < e)
        assert sorted((r.p, r.a) for r in found.collect()) == expected and expected
    both = time_joins.overlapping(left, right, ["k"], ("s", "e"), ("s2", "e2"))
    assert "NestedLoop" not in plan_of(both)
    expected = sorted((x[0], y[0]) for x in one for y in two if held(x) and held(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert sorted((r.a, r.b) for r in both.collect()) == expected and expected


def test_multiplied_rows_are_not_broadcast(spark):
    """A few thousand rows look small enough, whatever they are multiplied by."""
    points = spark.range(50).select(F.lit(1).alias("k"), F.lit(START).cast("timestamp_ntz").alias("at"))
    held = spark.createDataFrame([(1, START, START + dt.timedelta(hours=2**n)) for n in range(8)], "k int, s timestamp_ntz, e timestamp_ntz")
    other = spark.createDataFrame([(1, START, START + dt.timedelta(hours=3))], "k int, s2 timestamp_ntz, e2 timestamp_ntz")
    for found, rows in ((time_joins.points_in_intervals(points, held, ["k"], "at", "s", "e"), 400),
                        (time_joins.overlapping(held, other, ["k"], ("s", "e"), ("s2", "e2")), 8)):
        assert found.count() == rows
        plan = plan_of(found)
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_long_intervals_lie_in_few_buckets(spark):
    years = spark.createDataFrame([(1, dt.datetime(1990, 1, 1), dt.datetime(2030, 1, 1)), (1, START, START + dt.timedelta(seconds=1))],
                                  "k long, s timestamp_ntz, e timestamp_ntz")
    level = time_joins._level(F.col("s"), F.col("e"))
    wide = time_joins._width(level)
    pieces = years.select(time_joins.bucket(F.col("e"), wide) - time_joins.bucket(F.col("s"), wide)).collect()
    assert all(r[0] <= 2 for r in pieces)


def test_a_point_is_multiplied_by_few_levels(spark):
    """Intervals of an hour to over a hundred years."""
    lengths = spark.range(21).select(F.timestamp_seconds(F.lit(0)).alias("s"), F.timestamp_seconds(F.lit(3600) * F.pow(F.lit(2), "id")).alias("e"))
    level = time_joins._level(F.col("s"), F.col("e"))
    assert lengths.select(level.alias("level")).distinct().count() == 11
    short = lengths.where(F.unix_seconds("e") > time_joins._width(level))
    assert short.count() == 0


@pytest.mark.parametrize("width", [600, 86_400])
def test_sessions(spark, width):
    pick = random.Random(4)
    rows = [(pick.choice([1, 1, 1, 2, None]), t, pick.choice(["purchase", "view", None]), pick.choice([None, 1.25, 2.5])) for t in moments(pick, 300, 120)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string, value double")
    expected = []
    for user in (1, 2):
        number, own = 0, []
        for row in sorted((r for r in rows if r[0] == user and r[1] is not None), key=lambda r: r[1]):
            if own and row[1] > own[-1][1] + dt.timedelta(seconds=1800):
                number += 1
                expected.append((user, number, own))
                own = []
            own.append(row)
        expected.append((user, number + 1, own))
    expected = [(u, n, own[0][1], own[-1][1], len(own), sum(r[2] == "purchase" for r in own),
                 sum(r[3] for r in own if r[3] is not None) if any(r[3] is not None for r in own) else None) for u, n, own in expected]
    found = sessions.user_sessions(events, width=width).collect()
    assert sorted(tuple(r) for r in found) == sorted(expected)
    assert sessions.user_sessions(events.limit(0)).collect() == []


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_dominance(spark, block_rows):
    pick = random.Random(6)
    # A third of all rows have the same low value, a third the same high one; some rows are equal.
    rows = [(k, pick.choice([5, 5, pick.randrange(20), None]), pick.choice([3.0, pick.randrange(15) / 2, pick.randrange(15) / 2])) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, low long, high double").withColumn("x", F.lit("x"))
    found = {r.id: r.beaten_by for r in dominance.beaten_by(df, "low", "high", block_rows).collect()}
    full = [(low, high) for _, low, high in rows if low is not None]
    for k, low, high in rows:
        beats = sum(a <= low and b >= high and (a, b) != (low, high) for a, b in full) if low is not None else None
        assert found[k] == beats
    assert dominance.beaten_by(df, "low", "high", block_rows).columns == ["id", "low", "high", "x", "beaten_by"]
    assert dominance.beaten_by(df.limit(0), "low", "high").collect() == []
