import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def rows(df, cols):
    """Rows of a pandas frame as comparable tuples."""
    import pandas as pd

    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float):
            return repr(int(x)) if x == int(x) else repr(round(x, 9))
        return str(x)

    return sorted((tuple(plain(x) for x in r) for r in df[cols].astype(object).values.tolist()), key=str)


@pytest.fixture(scope="session")
def same(duck):
    """Assert that a Spark result equals what SQL says in DuckDB."""

    def check(df, sql):
        a, b = df.toPandas(), duck.execute(sql).df()
        cols = sorted(b.columns)
        assert sorted(a.columns) == cols
        assert rows(a, cols) == rows(b, cols)

    return check
