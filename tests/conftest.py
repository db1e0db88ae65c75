import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


def same_rows(df, duck, sql):
    """Both sides' rows, sorted, by column name."""
    cols = sorted(df.columns)
    r = duck.sql(sql)
    assert sorted(r.columns) == cols
    mine = sorted((tuple(_plain(x[c]) for c in cols) for x in df.collect()), key=repr)
    other = sorted((tuple(_plain(dict(zip(r.columns, x))[c]) for c in cols) for x in r.fetchall()), key=repr)
    return mine, other
