"""End-to-end skew: one account holds a third of all bookings.

The sf0.001 airline tables are rewritten so that every third booking (and
its passengers) belongs to account 0; the account-ordered jobs must still
equal the oracle run over the same tables.
"""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from layover.oracle.compare import same
from layover.plans import retention
from layover.plans.registry import JOBS
from layover.sources.adapter import TABLES, Airline

DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
              "string": "VARCHAR"}

JOBS_UNDER_SKEW = ["trips", "account_booking_rates", "time_to_next_by_ordinal", "time_to_next_flight_2",
                   "time_to_next_flight", "censored_accounts", "survival_table", "account_top_passenger",
                   "booking_count_comparison", "rate_posterior_by_missed", "account_rate_shrinkage",
                   "rate_interval", "account_rate_interval", "account_calibration", "implied_days_histogram",
                   "hierarchical_rate_fit", "account_hierarchical_rates"]


@pytest.fixture(scope="module")
def skewed(spark, stored_air):
    hot = F.when(F.col("booking_id") % 3 == 0, F.lit(0)).otherwise(F.col("account_id"))
    frames = {n: getattr(stored_air, n) for n in TABLES}
    frames["booking"] = frames["booking"].withColumn("account_id", hot.cast("long"))
    frames["passenger"] = frames["passenger"].withColumn(
        "account_id", F.when(F.col("account_id").isNull(), None).otherwise(hot).cast("long"))
    con = duckdb.connect()
    for n, df in frames.items():
        pdf = df.toPandas()
        con.register(f"{n}_pd", pdf)
        casts = ", ".join(f'CAST("{f.name}" AS {DUCK_TYPES[f.dataType.simpleString()]}) AS "{f.name}"'
                          for f in df.schema.fields)
        con.execute(f"CREATE TABLE {n} AS SELECT {casts} FROM {n}_pd")
    return frames, con


def test_hot_account_holds_a_third(skewed):
    frames, _ = skewed
    b = frames["booking"]
    assert b.where("account_id = 0").count() * 3 >= b.count()


@pytest.mark.parametrize("name", JOBS_UNDER_SKEW)
def test_jobs_under_skew_match_oracle(spark, skewed, name):
    frames, con = skewed
    air = Airline.from_frames(spark, **frames)
    got = JOBS[name](air).toPandas()
    want = con.execute(E.oracle_sql()[name].without_prefix()).df()
    ok, why = same(got, want)
    assert ok, f"{name}: {why}"


@pytest.mark.parametrize("name", ["trips", "missed_connections", "passenger_legs", "passenger_leg_boarding", "boarding_coverage"])
@pytest.mark.parametrize("many", [1000, 5])
def test_booking_with_a_third_of_all_legs(spark, stored_air, monkeypatch, name, many):
    """One booking holds a third of all legs; with a low limit it takes the parallel scan."""
    monkeypatch.setattr(retention, "MANY_LEGS", many)
    # (few passengers there, as the boarding joins multiply them with the legs)
    hot = F.when(F.col("booking_leg_id") % 3 == 0, F.lit(1)).otherwise(F.col("booking_id")).cast("long")
    frames = {n: getattr(stored_air, n) for n in TABLES}
    frames["booking_leg"] = frames["booking_leg"].withColumn("booking_id", hot)
    con = duckdb.connect()
    for n, df in frames.items():
        con.register(n, df.toPandas())
    got = JOBS[name](Airline.from_frames(spark, **frames)).toPandas()
    want = con.execute(E.oracle_sql()[name].without_prefix()).df()
    ok, why = same(got, want)
    assert ok, f"{name}: {why}"


@pytest.mark.parametrize("name", ["account_boarding_drilldown", "account_flight_drilldown", "slice_flight_drilldown"])
def test_drilldowns_of_a_booking_with_many_passengers(spark, stored_air, name):
    """One booking holds a tenth of all passengers, and some passengers have none."""
    frames = {n: getattr(stored_air, n) for n in TABLES}
    booking = F.when(F.col("passenger_id") % 10 == 1, F.lit(1)).when(F.col("passenger_id") % 77 != 0, F.col("booking_id")).cast("long")
    frames["passenger"] = frames["passenger"].withColumn("booking_id", booking)
    con = duckdb.connect()
    for n, df in frames.items():
        con.register(n, df.toPandas())
    got = JOBS[name](Airline.from_frames(spark, **frames)).toPandas()
    want = con.execute(E.oracle_sql()[name].without_prefix()).df()
    ok, why = same(got, want)
    assert ok, f"{name}: {why}"
