"""Every registered query runs, and gives the rows of its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(q for q in entry_points.queries() if not q.startswith("op") and q != "pipeline")


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(repr([None if v is None or v != v else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row]) for row in df.astype(object).where(df.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query(spark, sf_dir, db, name):
    got = entry_points.queries()[name](spark, sf_dir).toPandas()
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
