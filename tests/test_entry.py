"""Driver contract + DuckDB oracle agreement on the smallest scale factor."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from riskfuse.session import TABLES

SF = "/root/testdata/sf0.001"

def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "fraud_score" in df.columns and "decision" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(k for k in E.oracle_sql() if k in E._registry.QUERIES))
def test_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(ocols)
    idx = [ocols.index(c) for c in sdf.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    s_rows = sorted((tuple(norm(x) for x in r) for r in sdf.collect()), key=key)
    o_rows = sorted((tuple(norm(r[i]) for i in idx) for r in res.fetchall()), key=key)
    assert s_rows == o_rows
