import collections
import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(_norm, v)) if isinstance(v, list) else v


@pytest.fixture(scope="session")
def same(spark):
    """Compares a query with its SQL, as bags of rows, over all tables of a folder."""

    def check(query, sql, sf_dir=SF):
        con = duckdb.connect()
        for p in glob.glob(f"{sf_dir}/*.parquet"):
            con.execute(f"create view {os.path.basename(p).split('.')[0]} as select * from '{p}'")
        got = query(spark, sf_dir)
        cols = sorted(got.columns)
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        want = collections.Counter(tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
        assert collections.Counter(tuple(_norm(r[c]) for c in cols) for r in got.collect()) == want

    return check
