"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from braidwalk.queries import ORACLES, QUERIES

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{AT}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    got = QUERIES[name](spark, AT).toPandas()
    if name in ORACLES:
        assert plain(got) == plain(db.sql(ORACLES[name]).df())
    else:
        assert len(got)
