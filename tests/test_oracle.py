"""Every registered job equals its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from layover.oracle.compare import same
from layover.plans.registry import JOBS
from tests.conftest import SF_SMALL

SQL = {k: v for k, v in E.oracle_sql().items() if k in JOBS}
NAMES = sorted(SQL)


def test_every_job_is_registered_with_oracle_or_declared():
    rows_only = set(JOBS) - set(SQL)
    assert set(JOBS) <= set(E.queries())
    assert not rows_only, rows_only


@pytest.mark.parametrize("name", NAMES)
def test_job_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(SQL[name]).df()
    ok, why = same(got, want)
    assert ok, f"{name}: {why}"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "rate_mean" in df.columns


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", NAMES)
def test_job_types_match_oracle(spark, duck, name):
    """Column names and declared types agree (no DECIMAL/HUGEINT drift in the SQL)."""
    want = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    got = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
           for f in E.queries()[name](spark, SF_SMALL).schema.fields}
    assert got == want
