"""Every registered query gives the rows of its SQL."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry_point
from viewlog.plans.all_queries import ORACLES as SQL
from viewlog.plans.all_queries import QUERIES


@pytest.fixture(scope="module")
def duck(data):
    with oracle.connection(data) as con:
        yield con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, data, name):
    assert oracle.compare(spark, duck, QUERIES[name], SQL[name], data) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_point_has_every_query():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(SQL) <= set(entry_point.oracle_sql())


def test_entry_has_rows(spark, monkeypatch, data):
    monkeypatch.setattr(entry_point, "SMOKE_DIR", data)
    result = entry_point.entry(spark)
    assert result.columns == ["user", "revenue"]
    assert result.count() > 0
