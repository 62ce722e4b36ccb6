"""Every registered query runs, and equals its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from checks.compare import connect, difference
from checks.oracles import oracle_sql
from checks.queries import queries
from tests.conftest import SMALL

SQL = oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    result = queries()[name](spark, SMALL).toPandas()
    assert difference(result, connect(SMALL).execute(SQL[name]).df()) is None
