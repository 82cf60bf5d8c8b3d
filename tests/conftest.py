from __future__ import annotations

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from layover.session import build_session

    s = build_session(master="local[*]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    yield s


@pytest.fixture(scope="session")
def stored_air(spark):
    from layover.sources.adapter import stored

    return stored(spark, SF_SMALL)


@pytest.fixture()
def air(stored_air):
    return stored_air.fork()


@pytest.fixture(scope="session")
def duck():
    from layover.sources.tables import DRIVER_TABLES

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
