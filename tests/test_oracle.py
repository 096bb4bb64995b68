"""Every query with SQL against DuckDB on the smallest tables."""

import os

import numpy as np
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def canon(x):
    if isinstance(x, (list, np.ndarray)):
        return "[" + ",".join(map(canon, x)) + "]"
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    r = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    want = sorted(tuple(canon(dict(zip(columns, row))[c]) for c in sorted(columns)) for row in r.fetchall())
    got = sorted(tuple(canon(row[c]) for c in sorted(df.columns)) for row in df.collect())
    assert sorted(df.columns) == sorted(columns)
    assert got == want


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
