"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"


def plain(df: pd.DataFrame) -> list:
    def v(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list):
            return str([v(y) for y in x])
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)):
            return f"{float(x):.9g}"
        return str(x)

    return sorted(tuple(v(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    mine = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    assert plain(mine) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    """What SQL can't express is run; the values are compared with Python's in test_units."""
    rows = catalog.queries()[name](spark, SF).collect()
    assert rows and len({r[0] for r in rows}) == len(rows)  # one row a document
