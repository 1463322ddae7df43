"""Every core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from regionframe import queries as core

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    def norm(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) == "<NA>":
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(norm(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = core.QUERIES[name](spark, SF).toPandas()
    want = con.sql(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
