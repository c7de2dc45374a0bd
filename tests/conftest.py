import os
import sys

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The driver's tables, for tests that hold whole queries to their SQL.
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def same(spark, duck):
    """Hold a query to its SQL: equal columns and rows, in any order."""

    def check(df, sql):
        a, b = df.toPandas(), duck.execute(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)

        def plain(v):
            if hasattr(v, "__len__") and not isinstance(v, str):
                return str([plain(x) for x in v])
            return "null" if v is None or v is pd.NA or v != v else str(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

        text = lambda x: sorted(tuple(plain(v) for v in r) for r in x[cols].astype(object).to_numpy().tolist())
        assert text(a) == text(b)

    return check
