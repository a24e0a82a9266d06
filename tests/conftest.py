import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    """The folder of the smallest tables."""
    folder = os.environ.get("UMBRAL_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    return folder


@pytest.fixture(scope="session")
def duck(sf):
    """A DuckDB connection with a view of each table."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.fixture(scope="session")
def same_rows(duck):
    """Compares a DataFrame with SQL: columns by name, rows in any order."""

    def rounded(x):
        return round(x, 9) if isinstance(x, float) else x

    def compare(df, sql):
        result = duck.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        want = [tuple(rounded(r[names.index(c)]) for c in df.columns) for r in result.fetchall()]
        got = [tuple(map(rounded, r)) for r in df.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)

    return compare
