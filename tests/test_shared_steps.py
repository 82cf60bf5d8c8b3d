"""The steps that most jobs share: tables on first use, one deal of ordinary
keys, the parallel scan of large ones."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from layover.operators import ordered
from layover.oracle.compare import same
from layover.plans import retention
from layover.plans.registry import JOBS
from layover.sources.adapter import TABLES, Airline, StoredTables
from tests.conftest import SF_SMALL
from tests.test_operators import SCHEMA, _events


@pytest.mark.parametrize("most", [5, 60, 10_000])
def test_windows_and_scans_agree(spark, monkeypatch, most):
    """No key, the hot key or every key takes the scan."""
    monkeypatch.setattr(ordered, "MANY_ROWS", most)
    df = spark.createDataFrame(_events(7), SCHEMA)
    key = Window.partitionBy("k")
    pairs = [(ordered.running_sum(df, ["k"], "ts", F.col("v"), "r", "n"),
              df.withColumn("r", F.sum("v").over(key.orderBy("ts"))).withColumn("n", F.sum("v").over(key))),
             (ordered.row_index(df, ["k"], ["ts", "id"], "r"), df.withColumn("r", F.row_number().over(key.orderBy("ts", "id")))),
             (ordered.previous_event(df, ["k"], ["ts", "id"], ["v"], "p").select("k", "id", "p.*"),
              df.withColumn("p", F.lag(F.struct("ts", "id", "v")).over(key.orderBy("ts", "id"))).select("k", "id", "p.*"))]
    for got, want in pairs:
        got, want = (x.toDF(*[f"c{i}" for i in range(len(x.columns))]) for x in (got, want))
        ok, why = same(got.toPandas(), want.toPandas())
        assert ok, why


def test_an_ordinary_key_is_dealt_once(spark):
    plan = ordered.row_index(spark.createDataFrame(_events(7), SCHEMA), ["k"], ["ts", "id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_tables_are_made_on_first_use(spark, tmp_path):
    air = Airline(spark, frames=StoredTables(Airline.from_dir(spark, SF_SMALL), str(tmp_path)))
    assert JOBS["frequent_flyer_accounts"](air.fork()).count() > 0
    assert os.listdir(tmp_path) == []
    assert JOBS["trips"](air.fork()).count() > 0
    assert os.listdir(tmp_path) == ["booking_leg"]


def test_survival_export_deals_legs_by_flight_once(spark, stored_air, monkeypatch):
    """Censored rows come from the exported trips, not from the legs again."""
    seen = []
    real = retention.leg_flights
    monkeypatch.setattr(retention, "leg_flights", lambda a: seen.append(1) or real(a))
    air = Airline.from_frames(spark, **{n: getattr(stored_air, n) for n in TABLES})
    monkeypatch.setattr(retention, "_account_legs", None)
    assert JOBS["survival_table"](air).count() > 0
    assert len(seen) == 1


@pytest.mark.parametrize("name", ["censored_accounts", "survival_table"])
def test_last_legs_of_bookings_of_very_many_legs(spark, stored_air, monkeypatch, name):
    monkeypatch.setattr(retention, "MANY_LEGS", 5)
    hot = F.when(F.col("booking_leg_id") % 3 == 0, F.lit(1)).otherwise(F.col("booking_id")).cast("long")
    frames = {n: getattr(stored_air, n) for n in TABLES}
    frames["booking_leg"] = frames["booking_leg"].withColumn("booking_id", hot)
    con = duckdb.connect()
    for n, df in frames.items():
        con.register(n, df.toPandas())
    ok, why = same(JOBS[name](Airline.from_frames(spark, **frames)).toPandas(), con.execute(E.oracle_sql()[name].without_prefix()).df())
    assert ok, why


def test_shuffles_start_from_partitions_by_size(spark, monkeypatch):
    """The number that shuffles start from follows the tables, not the session alone."""
    from layover import session
    from layover.sources.adapter import stored

    conf = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        stored(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(conf)) == least
        monkeypatch.setattr(session, "DEAL_BYTES", 1000)
        air = stored(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(conf)) > 2 * least
        assert int(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == session.JOINED_BYTES
        assert air.booking_leg.groupBy("booking_id").count().count() == air.booking_leg.select("booking_id").distinct().count()
    finally:
        session.deal_by_size(spark)


def test_lead_days_export_stores_the_join_before_the_sort(spark):
    """Neither the bounds of the sort nor its rows repeat the join of legs and flights."""
    from layover.plans import bookings

    want = E._bind("booking_lead_days")(spark, SF_SMALL)
    tables = E.stored(spark, SF_SMALL).fork()
    got = bookings.booking_lead_days_export(tables)
    stored_rows = tables.staged("booking_lead_days")
    assert stored_rows is not None and stored_rows.count() == want.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
