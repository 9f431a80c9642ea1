"""Each query of the catalog against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillstone.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return made


def rows(df):
    def one(v):
        if v is None or v != v:
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(one, r)) for r in df.where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = con.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
