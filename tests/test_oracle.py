"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import pytest

import __spark_entry__ as entry_points
from oracle_check import compare, duck

from tests.conftest import SF_DIR

from registry import base


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF_DIR) == ""


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(base.ORACLE) == set(base.QUERIES)


def test_oracles_belong_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
