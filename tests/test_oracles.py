"""Every registered query with SQL gives DuckDB's rows."""

import pytest

import __spark_entry__ as entry
from tests.conftest import data_dir
from tests.oracle_check import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(data_dir())


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, data_dir()), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 14
