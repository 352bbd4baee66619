"""Every query with SQL returns what the SQL returns."""

import math
import os

import duckdb
import pytest

from tilewright import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float) or hasattr(v, "dtype"):
        return f"{float(v):.6f}" if float(v) != int(float(v)) else str(int(float(v)))
    return str(v)


def rows(frame, columns):
    return sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, data, db, name):
    got = q.queries()[name](spark, data).toPandas()
    want = db.sql(q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
