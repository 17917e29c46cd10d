"""Every query with a DuckDB form gives the same rows over the smallest tables."""

import glob
import os

import duckdb
import pytest

from corvid.plans import catalogue as Q

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_rows(spark, con, name):
    df, want = Q.QUERIES[name](spark, TABLES), con.sql(Q.ORACLES[name])
    assert canonical(df.collect(), df.columns) == canonical(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, TABLES).count() > 0
