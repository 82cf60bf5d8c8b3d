"""Hand-written edge frames through the jobs and the oracle
(the oracle runs over the same airline tables, without the adapter prefix)."""

from __future__ import annotations

from datetime import datetime as D

import duckdb
import pytest

import __spark_entry__ as E
from layover.oracle.compare import same
from layover.plans.registry import JOBS
from layover.sources.adapter import Airline

SCHEMAS = {
    "booking": "booking_id LONG, account_id LONG, update_ts TIMESTAMP_NTZ",
    "booking_leg": "booking_leg_id LONG, booking_id LONG, flight_id LONG, leg_num INT, is_returning BOOLEAN, "
                   "update_ts TIMESTAMP_NTZ",
    "flight": "flight_id LONG, flight_no STRING, scheduled_departure TIMESTAMP_NTZ, scheduled_arrival TIMESTAMP_NTZ, "
              "departure_airport STRING, arrival_airport STRING, status STRING, aircraft_code STRING, "
              "actual_departure TIMESTAMP_NTZ, actual_arrival TIMESTAMP_NTZ",
    "aircraft": "code STRING, model STRING, range INT, class STRING",
    "airport": "airport_code STRING, city STRING, airport_tz STRING",
    "account": "account_id LONG, first_name STRING, last_name STRING, frequent_flyer_id LONG",
    "frequent_flyer": "frequent_flyer_id LONG, level STRING, award_points INT",
    "passenger": "passenger_id LONG, booking_id LONG, account_id LONG, first_name STRING, last_name STRING, "
                 "update_ts TIMESTAMP_NTZ",
    "boarding_pass": "pass_id LONG, passenger_id LONG, booking_leg_id LONG, boarding_time TIMESTAMP_NTZ, "
                     "update_ts TIMESTAMP_NTZ",
}


def _edge_tables():
    d = D
    booking = [
        (1, 10, d(2000, 1, 1)),   # one leg
        (2, 10, d(2000, 1, 5)),   # two legs, tight connection -> missed
        (3, 10, d(2000, 1, 5)),   # same time as booking 2 (tied booking times)
        (4, 20, d(2000, 1, 2)),   # no legs at all
        (5, 20, d(2000, 1, 9)),   # leg on a flight with NULL arrival
        (6, 30, d(2000, 2, 1)),   # account with a single booking
        (7, 10, d(2000, 1, 20)),
        (8, 40, d(2000, 1, 6)),   # legs 1 and 3, tight connection -> missed
        (9, 40, d(2000, 1, 21)),  # two legs of one number
    ]
    legs = [
        (801, 8, 1001, 1, False, d(2000, 1, 6)),
        (803, 8, 1002, 3, False, d(2000, 1, 6)),
        (901, 9, 1006, 1, False, d(2000, 1, 21)),
        (902, 9, 1005, 1, False, d(2000, 1, 21)),
        (101, 1, 1000, 1, False, d(2000, 1, 1)),
        (201, 2, 1001, 1, False, d(2000, 1, 5)),
        (202, 2, 1002, 2, True, d(2000, 1, 5)),
        (301, 3, 1003, 1, False, d(2000, 1, 5)),
        (501, 5, 1004, 1, False, d(2000, 1, 9)),
        (601, 6, 1005, 1, False, d(2000, 2, 1)),
        (701, 7, 1006, 1, False, d(2000, 1, 20)),
    ]
    f = lambda i, dep, arr, adep, aarr, st="On schedule", ac="AC1": (
        i, f"F{i}", dep, arr, "N00", "N01", st, ac, adep, aarr)
    flights = [
        f(1000, d(2000, 1, 3, 10), d(2000, 1, 3, 12), d(2000, 1, 3, 10), d(2000, 1, 3, 12)),
        f(1001, d(2000, 1, 10, 8), d(2000, 1, 10, 9), d(2000, 1, 10, 8), d(2000, 1, 10, 9, 30), "Delayed"),
        f(1002, d(2000, 1, 10, 9, 30), d(2000, 1, 10, 11), d(2000, 1, 10, 9, 32), d(2000, 1, 10, 11)),
        f(1003, d(2000, 1, 10, 8), d(2000, 1, 10, 8), d(2000, 1, 10, 8), d(2000, 1, 10, 8)),  # zero length
        f(1004, d(2000, 1, 12), d(2000, 1, 12, 2), None, None, "Canceled", "AC9"),
        f(1005, d(2000, 2, 3), d(2000, 2, 3, 1), d(2000, 2, 3, 1), d(2000, 2, 3)),  # swapped times
        f(1006, d(2000, 1, 25), d(2000, 1, 25, 3), d(2000, 1, 25), d(2000, 1, 25, 3)),
    ]
    aircraft = [("AC1", "m1", 2000, "A")]
    airport = [("N00", "C0", "R0"), ("N01", "C1", "R1")]
    account = [(10, "Fn0", "Ln10", None), (20, None, "Ln20", 20), (30, "Fn3", None, 30), (40, "Fn4", "Ln40", None)]
    ff = [(20, "GOLD", 10), (30, "SILVER", 5)]
    passenger = [
        (10, 1, 10, "Fn0", "Ln10", d(2000, 1, 1)), (20, 2, 10, "Fn0", "Ln10", d(2000, 1, 5)),
        (21, 2, 10, "Fn1", "Ln10", d(2000, 1, 5)), (30, 3, None, None, "Ln10", d(2000, 1, 5)),
        (50, 5, 20, "Fn2", "Ln20", d(2000, 1, 9)), (60, 6, 30, "Fn3", None, d(2000, 2, 1)),
        (61, 6, 30, "Fn4", None, d(2000, 2, 1)), (70, 7, 10, "Fn0", "Ln10", d(2000, 1, 20)),
    ]
    bp = [(1010, 10, 101, d(2000, 1, 3, 9, 30), d(2000, 1, 3, 9, 30)),
          (2010, 20, 201, d(2000, 1, 10, 7, 30), d(2000, 1, 10, 7, 30))]
    return {"booking": booking, "booking_leg": legs, "flight": flights, "aircraft": aircraft, "airport": airport,
            "account": account, "frequent_flyer": ff, "passenger": passenger, "boarding_pass": bp}


@pytest.fixture(scope="module")
def edge(spark):
    data = _edge_tables()
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()}
    con = duckdb.connect()
    types = {"LONG": "BIGINT", "INT": "INTEGER", "STRING": "VARCHAR", "TIMESTAMP_NTZ": "TIMESTAMP",
             "BOOLEAN": "BOOLEAN"}
    for n, df in frames.items():
        con.register(f"{n}_pd", df.toPandas())
        cols = [c.strip().split(" ") for c in SCHEMAS[n].split(",")]
        sel = ", ".join(f'CAST("{c}" AS {types[t]}) AS "{c}"' for c, t in cols)
        con.execute(f"CREATE TABLE {n} AS SELECT {sel} FROM {n}_pd")
    return frames, con


# jobs whose SQL names tables of the adapter prefix only (not the driver's views)
SKIP = {"booking_lead_days_export"}


@pytest.mark.parametrize("name", sorted((set(E.oracle_sql()) & set(JOBS)) - SKIP))
def test_edge_frames_match_oracle(spark, edge, name):
    frames, con = edge
    air = Airline.from_frames(spark, **frames)
    got = JOBS[name](air).toPandas()
    want = con.execute(E.oracle_sql()[name].without_prefix()).df()
    ok, why = same(got, want)
    assert ok, f"{name}: {why}"


def test_empty_tables(spark):
    frames = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    air = Airline.from_frames(spark, **frames)
    for name in ("trips", "time_to_next_flight_2", "censored_accounts", "survival_table",
                 "flight_length_ntiles", "account_top_passenger", "account_rate_interval", "account_calibration",
                 "account_calibration_histogram", "shrunk_rate_breaks", "account_implied_days_histogram",
                 "account_hierarchical_rates"):
        assert JOBS[name](air).count() == 0, name
    # both groups are always reported, without data at their prior
    post = JOBS["rate_posterior_by_missed"](air).orderBy("missed_flight_flag").collect()
    assert [(r["missed_flight_flag"], r["n_events"], r["post_shape"], r["post_rate"]) for r in post] == [
        (0, 0, 0.8, 0.33), (1, 0, 0.8, 0.33)]
    # and so does the histogram of a group without data: its prior, on the grid of both
    masses = JOBS["implied_days_histogram"](air).groupBy("missed_flight_flag").sum("mass").collect()
    assert len(masses) == 2 and all(abs(r[1] - 1) < 1e-6 for r in masses)
