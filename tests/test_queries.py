"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.check import difference
from catalog.registry import ORACLES as SQL
from catalog.registry import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(queries())
    assert set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, folder, name):
    assert difference(spark, folder, QUERIES[name], SQL[name]) == ""


def test_entry(spark, folder):
    report = entry(spark)
    assert len(report.columns) == 30
    assert report.count() > 0
