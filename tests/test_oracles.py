"""Every registered query against its SQL twin on the smallest data set."""

import importlib

import pytest

from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    ok, note = compare(QUERIES[name](spark, SF_DIR), ORACLES[name], con)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
