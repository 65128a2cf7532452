"""Every query with SQL gives what DuckDB gives on the same files."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from provenloom.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    kind = type(v).__name__
    if "date" in kind.lower() or kind == "Timestamp":
        return str(v)[:10]
    return v if isinstance(v, (str, bool)) or kind.startswith("bool") else round(float(v), 6)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([plain(v) for v in r]) for r in df.to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    mine, theirs = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry_has_all_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
