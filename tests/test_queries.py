"""Every registered query against its SQL, on the smallest test tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    outcome = compare(name, queries()[name](spark, SF_DIR), connection)
    assert outcome.startswith(("ok", "rows only")), outcome


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["topic_id", "name", "label", "x", "y"]
    assert frame.count() > 0
