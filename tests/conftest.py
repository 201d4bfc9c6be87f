import numbers
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    """Rows as tuples, columns by name, numbers rounded, in order."""

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        return repr(round(float(v), 6)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    cols = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        assert rows_of(a) == rows_of(b)

    return check
