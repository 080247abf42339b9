"""Every registered query against its SQL in DuckDB on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
import __spark_entry__ as app  # noqa: E402
from tools.check import TABLES, norm  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_sql_has_a_query():
    assert set(app.oracle_sql()) <= set(app.queries())


@pytest.mark.parametrize("name", sorted(app.queries()))
def test_query(spark, db, name):
    df = app.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = app.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = db.execute(sql)
    names = [d[0] for d in res.description]
    assert norm(got, df.columns) == norm(res.fetchall(), names)


def test_entry(spark):
    df = app.entry(spark)
    assert df.count() == 10 and df.columns == ["obj_id", "p01", "median", "n_valid", "is_outlier"]
