"""Radix selection, heavy-key joins, bitmap counts, bootstrap, and the
parameters of jobs whose defaults leave them out, against plain arithmetic."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from layover.operators.bitmaps import distinct_count, set_counts
from layover.operators.heavy import heavy_join, heavy_keys
from layover.operators.selection import exact_quantiles, order_key, select_ranks
from layover.oracle.compare import same
from layover.plans import accounts, fleet, quality
from layover.plans import survival as S
from layover.plans.registry import JOBS


# ---------------------------------------------------------------- selection
def test_order_key_keeps_the_order(spark):
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1e-310, 1.0, 1.0000000000000002, 2.0, 1.9999999999999998, 4.0, 3.9999999999999996,
          1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 1e100, -1e-100]
    rnd = random.Random(5)
    xs += [rnd.choice([-1, 1]) * rnd.random() * 10.0 ** rnd.randint(-320, 300) for _ in range(500)]
    xs += [2.0 ** k for k in range(-1074, 1024, 7)] + [float(np.nextafter(2.0 ** k, 0)) for k in range(-1020, 1024, 7)]
    rows = spark.createDataFrame([(x,) for x in xs], "x DOUBLE").select("x", order_key(F.col("x")).alias("k")).collect()
    rows.sort(key=lambda r: r["x"])
    for a, b in zip(rows, rows[1:]):
        assert (a["x"] == b["x"]) == (a["k"] == b["k"]) and a["k"] <= b["k"], (a, b)
    nan = spark.createDataFrame([(float("nan"),)], "x DOUBLE").select(order_key(F.col("x"))).first()[0]
    assert nan > rows[-1]["k"]


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_of_groups_ties_and_extremes(spark, seed):
    rnd = random.Random(seed)
    rows = [(g, rnd.choice([rnd.gauss(0, 1e-9), rnd.gauss(0, 1e9), 3.0, -0.0, None])) for g in ("a", "b", None) for _ in range(rnd.randint(1, 400))]
    rows += [("c", 7.0)] * 500 + [("d", None)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE")
    probs = [0.0, 0.01, 0.5, 0.77, 1.0]
    got = exact_quantiles(df, "x", probs, group="g").toPandas()
    want = {g: pd.Series([x for k, x in rows if k == g and x is not None]).quantile(probs).tolist() for g in ("a", "b", None, "c")}
    assert set(got["g"].where(got["g"].notna(), None)) == set(want)
    for g, values in want.items():
        mine = got[got["g"].isna() if g is None else got["g"] == g].sort_values("q")["quantile"].tolist()
        assert mine == pytest.approx(values, rel=1e-12, abs=1e-24)


def test_select_ranks_of_all_rows(spark):
    xs = [random.Random(3).gauss(0, 5) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    wanted = spark.createDataFrame([(r,) for r in (1, 2, 500, 1999, 2000)], "rank LONG")
    got = {r["rank"]: r["_value"] for r in select_ranks(df, "x", wanted).collect()}
    assert got == {r: sorted(xs)[r - 1] for r in got} and len(got) == 5
    assert exact_quantiles(df.where("false"), "x", [0.5]).count() == 0


def test_quantile_plans_sort_nothing(spark, air):
    plans = []
    q = exact_quantiles(spark.range(1000).select(F.col("id").cast("double").alias("x")), "x", [0.5])
    plans.append(q._jdf.queryExecution().executedPlan().toString())
    plans.append(JOBS["rate_deciles"](air)._jdf.queryExecution().executedPlan().toString())
    assert not any("rangepartitioning" in p for p in plans)


# -------------------------------------------------------------- heavy joins
def _hot(spark, n=6000):
    left = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(n).where("id % 5 <> 2").select(F.col("id").alias("k"), (F.col("id") * 2).alias("b")).union(
        spark.range(20).select(F.lit(0).cast("long"), F.col("id")))
    return left, right


@pytest.mark.parametrize("how", ["left", "inner"])
def test_heavy_join_equals_join(spark, how):
    left, right = _hot(spark)
    got = heavy_join(left, right, "k", how).select("k", "a", "b").toPandas()
    want = left.join(right, "k", how).select("k", "a", "b").toPandas()
    assert same(got, want) == (True, "")
    with pytest.raises(ValueError):
        heavy_join(left, right, "k", "outer")


def test_hot_key_spreads_over_tasks(spark):
    left, right = _hot(spark, 60_000)
    keys = {r["k"]: r["salts"] for r in heavy_keys(left, "k", 16).collect()}
    assert set(keys) == {0} and keys[0] > 16
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        share = lambda df: max(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()) / df.count()
        plain, salted = share(left.join(right, "k", "left")), share(heavy_join(left, right, "k", "left", 16))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert plain > 0.3 and salted < 0.2, (plain, salted)


# ------------------------------------------------------------------ bitmaps
@pytest.mark.parametrize("ids", [list(range(0, 5000, 3)), [1, 1, 2, None, 32768, 32769, 65536], [-5, 0, 7, -40_000], [5 + 10 ** 12 * k for k in range(3000)],
                                 [-(1 << 63), (1 << 63) - 1, 0], [], [None]])
def test_distinct_counts(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids] * 2, "x LONG")
    assert distinct_count(df, "x", "n").collect()[0]["n"] == len({i for i in ids if i is not None})


@pytest.mark.parametrize("scale", [1, 10 ** 9])
def test_set_counts(spark, scale):
    a, b = {scale * i for i in range(3000)}, {scale * i for i in range(1000, 6000, 2)}
    left, right = (spark.createDataFrame([(i,) for i in s] + [(None,)], "x LONG") for s in (a, b))
    assert tuple(set_counts(left, right, "x").first()) == (len(a), len(b), len(a & b), len(a - b))
    assert tuple(set_counts(left, right.where("false"), "x").first()) == (len(a), 0, 0, len(a))


def test_coverage_shuffles_bitmaps(spark, air):
    plan = JOBS["passenger_id_coverage"](air)._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan
    assert not re.search(r"Exchange hashpartitioning\(passenger_id", plan)


# ---------------------------------------------------------------- bootstrap
def test_bootstrap_covers_the_true_ratio(spark):
    rng = np.random.default_rng(6)
    rows = []
    for sim in range(60):
        effect = rng.gamma(4.0, 0.25, 150)
        t0, t1 = rng.uniform(20, 200, 150), rng.uniform(5, 60, 150)
        d0, d1 = rng.poisson(0.1 * effect * t0), rng.poisson(0.15 * effect * t1)
        for i in range(150):
            tot = t0[i] + t1[i]
            rows.append((sim, i, float(d1[i] * t0[i] / tot), float(d0[i] * t1[i] / tot)))
    per = spark.createDataFrame(rows, "sim INT, account_id LONG, num DOUBLE, den DOUBLE")
    b = S.bootstrap_ratios(per, 200, keys=["sim"]).groupBy("sim").agg(F.percentile("ratio", F.array(F.lit(0.025), F.lit(0.975))).alias("e")).collect()
    inside = np.mean([r["e"][0] <= 1.5 <= r["e"][1] for r in b])
    assert len(b) == 60 and inside >= 0.85


def test_bootstrap_does_not_depend_on_partitioning(spark):
    per = spark.range(300).select(F.col("id").alias("account_id"), (F.col("id") % 7).cast("double").alias("num"), (F.col("id") % 5 + 1).cast("double").alias("den"))
    one = {r["replicate"]: r["ratio"] for r in S.bootstrap_ratios(per.coalesce(1), 50).collect()}
    many = {r["replicate"]: r["ratio"] for r in S.bootstrap_ratios(per.repartition(7), 50).collect()}
    assert one == pytest.approx(many) and len(one) == 50 and len(set(one.values())) > 40
    assert sum(S.POISSON[k] < 1 for k in range(10)) == 10 and S.POISSON[0] == pytest.approx(math.exp(-1))


# ------------------------------------- parameters that the defaults leave out
def _sql(duck, name, old, new):
    sql = str(E.oracle_sql()[name])
    assert old in sql, name
    return duck.execute(sql.replace(old, new)).df()


def test_excluded_flight_counts(air, duck):
    counts = duck.execute(str(E.oracle_sql()["route_flight_count_spread"])).df()["flight_count"]
    drop = sorted(set(counts.tolist()))[:1]
    got = fleet.route_flight_count_spread(air, excluded=drop).toPandas()
    assert 0 < len(got) < len(counts) and not got["flight_count"].isin(drop).any()
    left = duck.execute(f"SELECT * FROM ({E.oracle_sql()['route_flight_count_spread']}) WHERE flight_count NOT IN ({drop[0]})").df()
    # routes that keep all their aircraft keep their extremes
    whole = set(left["route"]) - set(duck.execute(f"SELECT route FROM ({E.oracle_sql()['route_flight_count_spread']}) WHERE flight_count IN ({drop[0]})").df()["route"])
    assert len(got) == len(left)
    assert same(got[got["route"].isin(whole)].reset_index(drop=True), left[left["route"].isin(whole)].reset_index(drop=True)) == (True, "")


def test_account_slice(air, duck):
    got = accounts.passenger_leg_boarding(air, modulus=10, remainder=3).toPandas()
    want = duck.execute(f"SELECT * FROM ({E.oracle_sql()['passenger_leg_boarding']}) WHERE account_id % 10 = 3").df()
    assert len(got) and same(got, want) == (True, "")


def test_one_route(air, duck):
    label = duck.execute(f"SELECT min(route) FROM ({E.oracle_sql()['route_durations']})").fetchone()[0]
    got = quality.route_durations(air, route_label=label).toPandas()
    want = duck.execute(f"SELECT * FROM ({E.oracle_sql()['route_durations']}) WHERE route = '{label}'").df()
    assert len(got) and same(got, want) == (True, "")


@pytest.mark.parametrize("n", [0, 7])
def test_first_rows(air, duck, n):
    got = accounts.boarding_leg_passenger_sample(air, n=n).toPandas()
    want = duck.execute(f"""SELECT * FROM ({E.oracle_sql()['boarding_leg_passenger_sample']})
        WHERE pass_id IN (SELECT pass_id FROM ({E.oracle_sql()['boarding_leg_passenger_sample']}) GROUP BY pass_id, booking_leg_id ORDER BY booking_leg_id, pass_id LIMIT {n})""").df()
    assert same(got, want) == (True, "")
    detail = accounts.passengers_without_boarding_detail(air.fork(), floor=100, n=n).toPandas()
    want = duck.execute(f"SELECT * FROM ({E.oracle_sql()['passengers_without_boarding_detail']}) WHERE passenger_id > 100 ORDER BY passenger_id LIMIT {n}").df()
    assert same(detail, want) == (True, "")
