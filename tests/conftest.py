import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_rows():
    """Compares a Spark result with what DuckDB's SQL gives on the same tables."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")

    def cell(x):
        """Whole numbers read alike, whether a null beside them has made floats of the column or not."""
        if x is None or x is pd.NA or isinstance(x, float) and np.isnan(x):
            return "null"
        if isinstance(x, float):
            return str(int(x)) if x.is_integer() else round(float(x), 6)
        return str(x)

    def rows(frame):
        named = frame[sorted(frame.columns)]
        return sorted((tuple(map(cell, r)) for r in named.itertuples(index=False)), key=str)

    def compare(df, sql):
        got, want = df.toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return compare
