"""One session for all tests, and the comparison of a query with its SQL twin."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Whether a query gives what its SQL gives, as bags of rows."""

    def check(query, sql):
        df = query(spark, DATA)
        got = canonical(df.columns, df.collect())
        ran = duck.execute(sql)
        want = canonical([c[0] for c in ran.description], ran.fetchall())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        differing = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
        assert not differing, differing[:3]

    return check
