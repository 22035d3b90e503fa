"""Every named query against its SQL on DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from plumbline.plans import CATALOGUE
from tools.check import differ

FOLDER = os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query(spark, con, name):
    q = CATALOGUE[name]
    got = q.frame(spark, FOLDER).toPandas()
    sql = q.check_sql()
    if sql is not None:
        assert differ(got, con.execute(sql).fetchdf()) is None
