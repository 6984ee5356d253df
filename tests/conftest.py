from __future__ import annotations

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA


def rows_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.select(columns).collect()), key=repr)


def sql_rows(sql: str, folder: str) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


@pytest.fixture(scope="session")
def same_rows():
    def check(df, sql: str, folder: str) -> None:
        got, want = rows_of(df), sql_rows(sql, folder)
        assert len(got) == len(want)
        assert got == want

    return check
