"""Equivalence of the skew-safe rewrites with the plain formulations."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from layover.operators.asof import next_booking_pairs, unmatched_first_booking
from layover.operators.firsts import argmax_ties, first_per_key
from layover.operators.histogram import equal_width
from layover.operators.ordered import previous_event, row_index, running_sum
from layover.operators.ranking import global_index, ntile
from layover.operators.selection import exact_quantiles
from layover.oracle.compare import same

T0 = datetime(2000, 1, 1)


def _events(seed: int, n: int = 400, hot_share: float = 0.4):
    """Skewed keys (one hot key), many tied timestamps."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < hot_share else rnd.randint(1, 12)
        ts = T0 + timedelta(hours=rnd.randint(0, 200), minutes=rnd.choice([0, 0, 30]))
        rows.append((key, ts, i, rnd.randint(0, 1)))
    return rows


SCHEMA = "k LONG, ts TIMESTAMP_NTZ, id LONG, v INT"


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("hot", [0.4, 0.9])
def test_running_sum_equals_window(spark, seed, hot):
    df = spark.createDataFrame(_events(seed, hot_share=hot), SCHEMA)
    got = running_sum(df, ["k"], "ts", value=F.col("v"), out="r", total="n")
    w = Window.partitionBy("k").orderBy("ts")
    want = df.withColumn("r", F.sum("v").over(w).cast("long")).withColumn(
        "n", F.sum("v").over(Window.partitionBy("k")).cast("long"))
    ok, why = same(got.toPandas(), want.toPandas())
    assert ok, why


@pytest.mark.parametrize("seed", [4, 5])
def test_row_index_equals_row_number(spark, seed):
    rows = [(k, ts if i % 7 else None, i, v) for (k, ts, i, v) in _events(seed)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = row_index(df, ["k"], ["ts", "id"], out="rn")
    w = Window.partitionBy("k").orderBy(F.col("ts").asc_nulls_last(), "id")
    want = df.withColumn("rn", F.row_number().over(w))
    ok, why = same(got.toPandas(), want.toPandas())
    assert ok, why


@pytest.mark.parametrize("seed", [6, 7])
def test_previous_event_equals_lag(spark, seed):
    df = spark.createDataFrame(_events(seed), SCHEMA)
    got = previous_event(df, ["k"], ["ts", "id"], payload=["v"], out="p")
    got = got.select("k", "ts", "id", "v", F.col("p.id").alias("pid"), F.col("p.v").alias("pv"))
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.select("k", "ts", "id", "v", F.lag("id").over(w).alias("pid"), F.lag("v").over(w).alias("pv"))
    ok, why = same(got.toPandas(), want.toPandas())
    assert ok, why


def test_hot_key_spans_partitions_and_ties_collapse(spark):
    """One key holds 90 % of the rows and one timestamp of it 1,000 copies:
    the scan splits the key over several partitions, and the result still
    equals the single-task window."""
    from layover.operators.ordered import _range_partitioned

    rows = [(0, T0, i, 1) for i in range(1000)]  # a group of copies
    rows += [(0, T0 + timedelta(minutes=i), 1000 + i, 1) for i in range(2000)]
    rows += [(k, T0 + timedelta(minutes=k), 5000 + k, 1) for k in range(1, 300)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = _range_partitioned(df, ["k"], [F.col("ts").asc_nulls_last()])
    spans = parts.where("k = 0").select("_pid").distinct().count()
    assert spans > 1
    got = running_sum(df, ["k"], "ts", out="r", total="n")
    want = df.withColumn("r", F.count(F.lit(1)).over(Window.partitionBy("k").orderBy("ts")).cast("long")) \
             .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k")).cast("long"))
    ok, why = same(got.toPandas(), want.toPandas())
    assert ok, why


def test_global_index_and_ntile(spark):
    rnd = random.Random(9)
    rows = [(i, float(rnd.randint(0, 50))) for i in range(1003)]
    df = spark.createDataFrame(rows, "id LONG, x DOUBLE")
    got = global_index(df, ["x", "id"], out="i").toPandas().sort_values("i")
    assert list(got["i"]) == list(range(1, 1004))
    assert list(got["x"]) == sorted(got["x"])
    nt = ntile(df, ["x", "id"], 50, out="nt")
    w = Window.orderBy("x", "id")  # the plain form, single partition: fine for a test
    want = df.withColumn("nt", F.ntile(50).over(w))
    ok, why = same(nt.toPandas(), want.toPandas())
    assert ok, why


def test_exact_quantiles_match_linear_interpolation(spark):
    rnd = random.Random(11)
    xs = [rnd.gauss(0, 1) for _ in range(501)] + [None]
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, "x", probs).toPandas().sort_values("q")
    want = pd.Series([x for x in xs if x is not None]).quantile(probs, interpolation="linear")
    assert got["quantile"].round(12).tolist() == want.round(12).tolist()


def test_grouped_quantiles(spark):
    rows = [(g, float(i)) for g in ("a", "b") for i in range(10 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE")
    got = exact_quantiles(df, "x", [0.5], group="g").toPandas().set_index("g")["quantile"].to_dict()
    assert got == {"a": 4.5, "b": 1.0}


def test_first_per_key_and_argmax_ties(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 1, "y"), (1, 1, "z"), (2, 5, "w")], "k INT, o INT, p STRING")
    f = first_per_key(df, ["k"], ["o", "p"]).toPandas().sort_values("k")
    assert f.values.tolist() == [[1, 1, "y"], [2, 5, "w"]]
    t = argmax_ties(df, ["k"], "o").toPandas()
    assert sorted(t["p"]) == ["w", "x"]
    t2 = argmax_ties(df.withColumn("o", F.lit(1)), ["k"], "o").toPandas()
    assert len(t2) == 4  # ties kept


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 10]], "x DOUBLE")
    h = equal_width(df, "x", 5).toPandas().sort_values("bin")
    assert h["n"].sum() == 6
    assert h["bin"].max() == 4  # x == hi lands in the last bin


# --- T1: merged timeline vs the literal range join + two DISTINCT ON passes -------
def _literal_pairs(spark, bookings, arrivals):
    bookings.createOrReplaceTempView("b")
    arrivals.createOrReplaceTempView("a")
    return spark.sql("""
        WITH cand AS (
          SELECT b.account_id, b.booking_ts AS updat_ts, b.booking_id, a.arrival_ts AS actual_arrival,
                 a.arrival_id AS booking_id_2,
                 (unix_micros(cast(b.booking_ts as timestamp)) - unix_micros(cast(a.arrival_ts as timestamp))) / 3.6e9
                   AS hours_to_next_booking
          FROM b JOIN a ON b.account_id = a.account_id AND b.booking_ts > a.arrival_ts),
        p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id, actual_arrival
                 ORDER BY hours_to_next_booking, updat_ts, booking_id, booking_id_2) AS r1 FROM cand) WHERE r1 = 1),
        p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id, updat_ts
                 ORDER BY hours_to_next_booking, booking_id, booking_id_2) AS r2 FROM p1) WHERE r2 = 1)
        SELECT account_id, updat_ts, booking_id, actual_arrival, booking_id_2, hours_to_next_booking FROM p2""")


@pytest.mark.parametrize("seed", [21, 22, 23])
def test_timeline_pairs_equal_range_join(spark, seed):
    rnd = random.Random(seed)
    b, a = [], []
    for i in range(300):
        acc = 0 if rnd.random() < 0.3 else rnd.randint(1, 20)
        ts = T0 + timedelta(days=rnd.randint(0, 60))
        b.append((acc, ts, i))
        if rnd.random() < 0.8:
            # arrival exactly at another booking time sometimes (strict > must exclude it)
            arr = ts + timedelta(days=rnd.choice([0, 1, 3, 10]), hours=rnd.choice([0, 0, 5]))
            a.append((acc, arr, i))
    bookings = spark.createDataFrame(b, "account_id LONG, booking_ts TIMESTAMP_NTZ, booking_id LONG")
    arrivals = spark.createDataFrame(a, "account_id LONG, arrival_ts TIMESTAMP_NTZ, arrival_id LONG")
    got = next_booking_pairs(bookings, arrivals)
    want = _literal_pairs(spark, bookings, arrivals)
    ok, why = same(got.toPandas(), want.toPandas())
    assert ok, why
    lone = unmatched_first_booking(bookings, arrivals).toPandas()
    assert lone["account_id"].is_unique
