import math
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("duoscope-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(x):
    """A value in a spelling that both engines share."""
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x + 0.0:.5g}" if x != int(x) or abs(x) > 1e15 else str(int(x))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def same_rows(spark, query, sql, root):
    """Compares a query with its SQL over the same tables."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(root):
        con.execute(f"create view {f.split('.')[0]} as select * from '{root}/{f}'")
    df = query(spark, root)
    mine = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
    assert mine == theirs
