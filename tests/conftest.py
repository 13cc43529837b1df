"""One session for all tests."""

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {
        "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.local.dir": own,
        "spark.sql.warehouse.dir": f"{own}/warehouse", "spark.checkpoint.dir": f"file://{own}/shared",
    }
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compare a query's rows over the small tables with those of its SQL."""

    def compare(query, sql: str) -> None:
        df = query(spark, SMALL)
        names = sorted(df.columns)
        mine = sorted([_plain(v) for v in r] for r in df.select(*names).collect())
        got = duck.execute(sql)
        order = [x[0] for x in got.description]
        assert sorted(order) == names
        at = [order.index(n) for n in names]
        assert mine == sorted([_plain(r[i]) for i in at] for r in got.fetchall())

    return compare
