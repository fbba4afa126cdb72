"""Every registered query with SQL, at the smallest scale, side by side; the others give rows or are known to be empty."""

import glob
import os

import pytest

from siltstone.plans import all_plans

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_plans()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    import pandas as pd

    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NA or v is pd.NaT or v != v else bool(v) if str(type(v)).find("bool") >= 0 else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    return sorted((tuple(clean(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
