import glob
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(frame, digits=6):
    """Rows as sorted tuples by sorted column names, with floats rounded and nulls alike."""
    cols = sorted(frame.columns)

    def cell(v):
        if v is None or v is pd.NA or v != v:
            return ""
        if isinstance(v, numbers.Real) and not isinstance(v, bool | np.bool_):
            return f"{round(float(v), digits):.{digits}f}"
        return str(v)

    return cols, sorted(tuple(cell(v) for v in row) for row in frame[cols].itertuples(index=False, name=None))
