"""Rules on literal rows against the rows that they demand."""

import duckdb
import pytest

from tests import literal_cases
from tests.test_queries import rows


@pytest.mark.parametrize("name", sorted(literal_cases.QUERIES))
def test_case(spark, name):
    df = literal_cases.QUERIES[name](spark, "")
    cursor = duckdb.connect().execute(literal_cases.SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cursor.description], cursor.fetchall())
