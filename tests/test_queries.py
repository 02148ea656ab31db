"""Every registered query of the library against its SQL on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from quillmark.catalog import TABLES
from quillmark.plans import cases, charts, extra, ledgers, relational, structure

FOLDER = "/root/testdata/sf0.001"
QUERIES = {**relational.QUERIES, **charts.QUERIES, **extra.QUERIES, **cases.QUERIES, **ledgers.QUERIES, **structure.QUERIES}
SQL = {**relational.SQL, **charts.SQL, **extra.SQL, **cases.SQL, **ledgers.SQL, **structure.SQL}

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in values], key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cursor.fetchall())
