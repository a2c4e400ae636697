"""Every registered query against its SQL text on the smallest data folder."""

import pytest

from storyflow.plans.catalog import oracle_sql, queries
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()
# Streams and multi-step runs without a SQL twin are covered by their own tests.
NO_SQL = {"src_08", "ud_01"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == NO_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    message, _ = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert message.startswith(("ok", "rows-only")), message


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
