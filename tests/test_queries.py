"""Every registered query beside its DuckDB SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as spark_entry
from checks.compare import compare, connect
from checks.oracle import oracle_sql
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, SF, name, oracle_sql()[name]) is None


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 150
