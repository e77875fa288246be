"""Every reference query against DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from ledgerloom import catalog

DATA = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def rows(df: pd.DataFrame):
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return None
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float):
            return round(x, 6)
        return str(x) if isinstance(x, pd.Timestamp) else x

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {t.stem} as select * from '{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    if sql := catalog.oracle_sql().get(name):
        assert rows(got) == rows(duck.execute(sql).df())
