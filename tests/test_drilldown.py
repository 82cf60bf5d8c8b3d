"""Drill-downs pair legs and passes after sorting."""

from __future__ import annotations

import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from layover.oracle.compare import same
from layover.plans import accounts
from layover.plans.registry import JOBS
from layover.sources.adapter import TABLES, Airline

ORDERS = {"account_boarding_drilldown": list(accounts.DRILLDOWN_ORDER), "account_flight_drilldown": list(accounts.DRILLDOWN_ORDER),
          "slice_flight_drilldown": ["flight_no", "scheduled_departure", "passenger_id", "booking_leg_id", "pass_id"]}


@pytest.mark.parametrize("listed", [2, 256])
@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_and_order(spark, stored_air, duck, monkeypatch, name, listed):
    """Also where legs and passes need many lists."""
    monkeypatch.setattr(accounts, "LISTED", listed)
    got = JOBS[name](stored_air.fork()).toPandas()
    ok, why = same(got, duck.execute(E.oracle_sql()[name]).df())
    assert ok, why
    keys = [tuple((v is None or v != v, v) for v in r) for r in got[ORDERS[name]].astype(object).itertuples(index=False)]
    keys = [tuple((n, 0 if n else v) for n, v in k) for k in keys]
    assert keys == sorted(keys)


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_pairs_are_made_after_the_sort(air, name):
    plan = JOBS[name](air)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_passes") < plan.index("Sort [")


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_legs_are_dealt_by_booking_once(air, monkeypatch, name):
    """With their flights they are wide: without heavy keys no salt moves their lists again."""
    plans, store = {}, Airline.store
    monkeypatch.setattr(Airline, "store", lambda a, what, df: (plans.update({what: df._jdf.queryExecution().executedPlan().toString()}), store(a, what, df))[1])
    JOBS[name](air)
    assert "_salt" not in plans["passengers_legs"]
    assert plans["passengers_legs"].count("Exchange hashpartitioning(booking_id") <= 2


def test_stored_steps_free_their_shuffles(spark, air):
    def shuffled() -> int:
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return sum(f.startswith("shuffle_") and f.endswith(".data") for top in dirs for _, _, files in os.walk(top) for f in files)

    before = shuffled()
    df, _ = air.store("counts", air.passenger.groupBy("booking_id").agg(F.count(F.lit(1)).alias("n")))
    for _ in range(100):  # files are deleted in the background
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert df.agg(F.sum("n")).first()[0] == air.passenger.count()


def test_passengers_times_legs_are_not_dealt(spark, air):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = JOBS["passenger_leg_boarding"](air)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange hashpartitioning(booking_id" in plan and "Exchange hashpartitioning(booking_leg_id" not in plan
