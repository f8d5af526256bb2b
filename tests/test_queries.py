"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tiersum.jobs import catalog

DATA = Path(os.environ.get("TIERSUM_TESTDATA", "/root/testdata/sf0.001"))
CHECKED = list(catalog.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def comparable(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(tuple, df.where(df.notna(), None).values.tolist()), key=str)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    own = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(own.columns) == sorted(want.columns)
    a, b = comparable(own), comparable(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and p == pytest.approx(q, abs=2e-6)) for p, q in zip(x, y)), (x, y)
