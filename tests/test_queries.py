"""Every registered query with SQL against DuckDB on the smallest tables; the others must run."""

import glob
import os

import duckdb
import pytest

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q))
def test_matches_sql(spark, con, name):
    df = Q[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    if name in SQL:
        rel = con.sql(SQL[name])
        assert sorted(rel.columns) == cols
        want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
        assert got == want


def test_entry_and_names():
    assert set(SQL) <= set(Q)
    assert "fast_answer" in Q
