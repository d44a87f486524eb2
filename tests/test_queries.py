"""Every query of the library against its SQL on the small tables."""

import os

import duckdb
import pytest

from evidentia import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
NAMES = sorted(plans.oracles())


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(plain(v) for v in value) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    df = plans.queries()[name](spark, DATA)
    want = con.sql(plans.oracles()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(r[want.columns.index(c)]) for c in columns)) for r in want.fetchall())
    assert got


def test_every_oracle_has_its_query():
    assert set(plans.oracles()) <= set(plans.queries())
