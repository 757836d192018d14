"""Every registered query against its SQL on the smallest tables."""

import pytest
from checker import compare, make_duckdb

import __spark_entry__ as entry
from loomlog.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return make_duckdb(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_date", "dau", "mau", "stickiness", "sum_of_dau"]
    assert df.count() > 0
