"""Every core query with SQL gives what DuckDB gives on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

from tessera.plans import core_queries

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def _rows(frame):
    norm = lambda v: None if v is None or pd.isna(v) else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted((tuple(norm(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def base():
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(core_queries.oracle_sql()))
def test_same_as_sql(spark, base, name):
    got = core_queries.queries()[name](spark, FOLDER).toPandas()
    want = base.sql(core_queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
