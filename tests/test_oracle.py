"""Every registered query with SQL gives the SQL's rows."""

import glob
import os

import duckdb
import pytest

from corvane import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(pdf, columns):
    return sorted(map(tuple, pdf[columns].astype(object).where(pdf[columns].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        want = duck.execute(catalog.ORACLE_SQL[name]).df()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        assert rows(got, columns) == rows(want, columns)
    else:
        assert len(got)
