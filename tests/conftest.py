import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (HERE, os.environ.get("PYTHONPATH"))))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SF_DIR, LARGER_DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def connected(folder):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


@pytest.fixture(scope="session")
def duck():
    return connected(SF_DIR)


@pytest.fixture(scope="session")
def duck_larger():
    return connected(LARGER_DIR)


def plain(value):
    """A value that compares the same from either engine."""
    if isinstance(value, float):
        return repr(round(value, 8))
    if isinstance(value, (list, tuple)):
        return repr([plain(x) for x in value])
    return repr(value)


def same(frame, relation):
    """Whether a DataFrame and a DuckDB relation have the same columns and rows, in any order."""
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    theirs = sorted(tuple(plain(r[k]) for k in at) for r in relation.fetchall())
    assert ours == theirs
