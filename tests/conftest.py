import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    import pandas as pd

    if hasattr(x, "__len__") and not isinstance(x, str):
        return str(list(x))
    if pd.isna(x):
        return None
    if isinstance(x, str):
        return x
    return int(x) if float(x) == int(x) else float(x)


@pytest.fixture(scope="session")
def same():
    """Compare a Spark frame with a DuckDB result: names, rows and values, in any order."""

    def check(df, want):
        got = df.toPandas()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        rows = lambda f: sorted(repr(tuple(map(_plain, r))) for r in f[columns].itertuples(index=False))
        assert rows(got) == rows(want)

    return check
