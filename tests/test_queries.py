"""Every registered path query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from pathloom import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(df, cols):
    plain = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).map(plain).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(name, spark, db):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), db.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
