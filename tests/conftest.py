import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from sparkweave import spark_session

    session = spark_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(SMALL):
        pytest.skip(f"no test tables in {SMALL}")
    return SMALL


def duck(folder):
    import duckdb

    connection = duckdb.connect()
    for name in os.listdir(folder):
        table = name.removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{name}'")
    return connection


def plain(value):
    """A value in one form for both engines."""
    import decimal
    import math

    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 7) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def same(df, relation):
    """Whether a DataFrame and a DuckDB relation have the same columns and rows, in any order."""
    assert sorted(df.columns) == sorted(relation.columns)
    names, key = sorted(df.columns), lambda row: [(v is None, str(v)) for v in row]
    ours = sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=key)
    at = [relation.columns.index(n) for n in names]
    theirs = sorted((tuple(plain(row[k]) for k in at) for row in relation.fetchall()), key=key)
    assert ours == theirs
