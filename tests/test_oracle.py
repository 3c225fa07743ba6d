"""Every registered query with a SQL counterpart, compared row by row with DuckDB."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def duck(folder):
    connection = connect(folder)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, folder, duck, name):
    assert difference(queries()[name](spark, folder), duck, oracle_sql()[name]) is None


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
    without = {name for name in set(queries()) - set(oracle_sql()) if not re.match(r"op\d+_|pipeline$", name)}
    assert not without


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 5
    assert [r.units_sold for r in rows] == sorted((r.units_sold for r in rows), reverse=True)
