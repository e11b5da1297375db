"""Every registered query with a SQL form against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from locatext import catalog
from locatext.session import TABLES

D = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return f"{v.isoformat()}T00:00:00"
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, D).count() > 0
