"""Every training-data query with SQL gives DuckDB's rows."""

import pytest

from tests.conftest import data_dir
from tests.oracle_check import compare, connect
from trajloom.llm.oracle import ORACLE_SQL
from trajloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, data_dir()), connect(data_dir()), ORACLE_SQL[name]) is None
