"""Gamma distribution, break rule and posterior jobs against independent
arithmetic: high-precision sums, hand-computed breaks, simulated accounts."""

from __future__ import annotations

import math
from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from layover.functions.gamma import gamma_cdf, gamma_quantile, gamma_sf, log_gamma
from layover.operators.histogram import equal_width, nice_breaks
from layover.plans import posterior as P
from layover.plans import survival as S

SHAPES = (0.8, 1.0, 1.8, 9.9, 10.0, 57.3, 1234.5, 1e5, 1e6)
PROBS = (0.025, 0.1, 0.5, 0.9, 0.975)


def _log_gamma(a: Decimal) -> Decimal:
    """Stirling's series after a shift to 60, in 50 digits."""
    shift = Decimal(0)
    while a < 60:
        shift += a.ln()
        a += 1
    bernoulli = [(1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400), (43867, 244188), (-174611, 125400)]
    pi = Decimal("3.14159265358979323846264338327950288419716939937510")
    s = sum(Decimal(n) / d / a ** (2 * k + 1) for k, (n, d) in enumerate(bernoulli))
    return (a - Decimal("0.5")) * a.ln() - a + (2 * pi).ln() / 2 + s - shift


def _cdf(a: float, x: float) -> Decimal:
    getcontext().prec = 50
    a, x = Decimal(a), Decimal(x)
    term = total = Decimal(1)
    n = 0
    while term > total * Decimal("1e-30"):
        n += 1
        term *= x / (a + n)
        total += term
    return (a * x.ln() - x - _log_gamma(a + 1)).exp() * total


def test_quantiles_invert_a_high_precision_distribution(spark):
    df = spark.createDataFrame([(a,) for a in SHAPES], "a DOUBLE")
    rows = df.select("a", *[gamma_quantile(F.col("a"), p).alias(str(p)) for p in PROBS]).collect()
    for r in rows:
        for p in PROBS:
            x, a = r[str(p)], r["a"]
            density = math.exp((a - 1) * math.log(x) - x - math.lgamma(a)) if a < 1e4 else math.exp(-(x - a) ** 2 / (2 * a)) / math.sqrt(2 * math.pi * a)
            # error of the quantile: error of the distribution function over the density
            assert abs(float(_cdf(a, x) - Decimal(p))) / density <= 1e-9 * x, (a, p)


def test_cdf_just_below_the_branch_point(spark):
    """Where the series' ratio x / (a + 1) is 1 but for some last bits."""
    points = [(a, x) for a in (0.8, 4.0, 57.3, 1234.5) for x in (math.nextafter(a + 1, 0), (a + 1) * (1 - 1e-15), (a + 1) * (1 - 1e-12), (a + 1) * (1 - 1e-9), a + 1)]
    rows = spark.createDataFrame(points, "a DOUBLE, x DOUBLE").select("a", "x", gamma_cdf(F.col("a"), F.col("x")).alias("p"), gamma_sf(F.col("a"), F.col("x")).alias("q")).collect()
    for r in rows:
        p = _cdf(r["a"], r["x"])
        assert abs(float(Decimal(r["p"]) - p)) < 1e-12 and abs(float(Decimal(r["q"]) - (1 - p))) < 1e-12, r


def test_cdf_and_tail(spark):
    points = [(a, a * f) for a in SHAPES for f in (1e-3, 0.5, 0.97, 1.0, 1.02, 1.5, 4.0) if a < 1e5 or abs(f - 1) < 0.1]
    rows = spark.createDataFrame(points, "a DOUBLE, x DOUBLE").select("a", "x", gamma_cdf(F.col("a"), F.col("x")).alias("p"), gamma_sf(F.col("a"), F.col("x")).alias("q")).collect()
    for r in rows:
        want = _cdf(r["a"], r["x"])
        assert abs(float(Decimal(r["p"]) - want)) < 1e-12
        if 1e-25 < 1 - want < 0.5:
            assert float(Decimal(r["q"]) / (1 - want)) == pytest.approx(1, abs=1e-9)


def test_closed_forms_and_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -3.0), (0.0, 1.0), (None, 1.0), (2.0, None), (3.0, float("inf"))], "a DOUBLE, x DOUBLE")
    got = [tuple(r) for r in df.select(gamma_cdf(F.col("a"), F.col("x")), gamma_sf(F.col("a"), F.col("x")), gamma_quantile(F.col("a"), 0.3)).collect()]
    assert got[0] == pytest.approx((1 - math.exp(-2), math.exp(-2), -math.log(0.7)), rel=1e-13)
    assert got[1][:2] == (0.0, 1.0) and got[2][:2] == (0.0, 1.0) and got[6][:2] == (1.0, 0.0)
    assert got[3] == got[4] == (None, None, None) and got[5][:2] == (None, None)
    lg = spark.createDataFrame([(a,) for a in (0.01, 0.8, 5.5, 1e7)], "a DOUBLE").select("a", log_gamma(F.col("a"))).collect()
    assert all(v == pytest.approx(math.lgamma(a), rel=1e-14, abs=1e-13) for a, v in lg)


#: range, n -> first edge, width, number of bins, worked out by hand
BREAKS = [((0.0, 1.0), 30, 0.0, 0.05, 20), ((0.0, 10.0), 5, 0.0, 2.0, 5), ((1.0, 9.0), 10, 1.0, 1.0, 8), ((-3.2, 4.1), 7, -4.0, 1.0, 9),
          ((0.013, 0.0987), 30, 0.01, 0.005, 18), ((12.0, 987.0), 10, 0.0, 100.0, 10), ((100.0, 101.0), 4, 100.0, 0.2, 5),
          ((-50.0, -7.0), 10, -50.0, 5.0, 9), ((0.0, 3e6), 3, 0.0, 1e6, 3), ((2.5, 7.5), 1, 0.0, 5.0, 2)]


@pytest.mark.parametrize("span,n,first,width,bins", BREAKS)
def test_break_rule(spark, span, n, first, width, bins):
    lo, hi = span
    xs = [lo + (hi - lo) * k / 1000 for k in range(1001)]
    got = nice_breaks(spark.createDataFrame([(x,) for x in xs], "x DOUBLE"), "x", n).orderBy("bin").toPandas()
    assert got["n"].sum() == 1001
    assert got["bin"].iloc[0] == 0 and got["bin"].iloc[-1] == bins - 1
    assert got["bin_lo"].iloc[0] == pytest.approx(first, abs=1e-9)
    assert got["bin_hi"].iloc[-1] == pytest.approx(first + bins * width)
    assert np.allclose(got["bin_hi"] - got["bin_lo"], width)
    edges = first + width * np.arange(bins + 1)
    counts = [sum((a - 1e-9 * width * (i == 0) < x or (i == 0 and x == a)) and a + 1e-7 * width < x + (i == 0) * 1e9 and x <= b + 1e-7 * width for x in xs)
              for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    assert dict(zip(got["bin"], got["n"], strict=True)) == {i: c for i, c in enumerate(counts) if c}


def test_no_row_is_lost(spark):
    df = spark.createDataFrame([(float(x),) for x in range(-5, 16)] + [(None,)], "x DOUBLE")
    for h in (equal_width(df, "x", 5, 0.0, 10.0), nice_breaks(df, "x", 5, 0.0, 10.0)):
        got = {r["bin"]: r for r in h.collect()}
        assert sum(r["n"] for r in got.values()) == 21 and got[-1]["n"] == 5 and got[5]["n"] == 5
        assert got[-1]["bin_lo"] is None and got[-1]["bin_hi"] == 0.0 and got[5]["bin_lo"] == 10.0 and got[5]["bin_hi"] is None
    same = nice_breaks(spark.createDataFrame([(4.0,)] * 3, "x DOUBLE"), "x", 5).collect()
    assert [tuple(r) for r in same] == [(0, 4.0, 4.0, 3)]
    assert nice_breaks(df.where("false"), "x", 5).count() == 0


def _per(spark, rows):
    return spark.createDataFrame(rows, "account_id LONG, n_rows LONG, n_missed LONG, events LONG, exposure_days DOUBLE")


def test_account_ranks_are_uniform_where_the_model_holds(spark):
    rng = np.random.default_rng(8)
    true = rng.gamma(2.0, 1 / 20.0, 3000)
    t = rng.uniform(5, 200, 3000)
    per = _per(spark, [(i, 1, 0, int(rng.poisson(r * x)), float(x)) for i, (r, x) in enumerate(zip(true, t, strict=True))])
    x = P.account_posteriors(per).join(spark.createDataFrame([(i, float(r)) for i, r in enumerate(true)], "account_id LONG, true DOUBLE"), "account_id")
    ranks = np.array([r[0] for r in x.select(gamma_cdf(F.col("shape"), F.col("rate") * F.col("true"))).collect()])
    assert abs(ranks.mean() - 0.5) < 0.02 and abs(np.quantile(ranks, [0.1, 0.9]) - [0.1, 0.9]).max() < 0.03
    inside = x.select(F.avg(((F.col("true") > gamma_quantile(F.col("shape"), 0.1) / F.col("rate"))
                             & (F.col("true") < gamma_quantile(F.col("shape"), 0.9) / F.col("rate"))).cast("int"))).first()[0]
    assert abs(inside - 0.8) < 0.03


def test_population_without_spread_is_a_point(spark):
    x = P.account_posteriors(_per(spark, [(i, 2, 0, 2, 10.0) for i in range(20)])).first()
    assert x["shape"] is None and x["shrunk_rate"] == pytest.approx(0.2)


def test_implied_days_masses_sum_to_one_on_one_grid(air):
    got = P.implied_days_histogram(air).toPandas()
    assert np.allclose(got.groupby("missed_flight_flag")["mass"].sum(), 1, atol=1e-7)
    made, missed = (g.drop(columns=["missed_flight_flag", "mass"]).reset_index(drop=True) for _, g in got.sort_values("bin").groupby("missed_flight_flag"))
    assert made.equals(missed)
    acc = P.account_implied_days_histogram(air.fork()).toPandas()
    assert np.allclose(acc.groupby("has_missed")["mass"].sum(), 1, atol=1e-7)


def test_group_masses_equal_simulated_shares(spark):
    rng = np.random.default_rng(2)
    days = 1 / rng.gamma(40.0, 1 / 300.0, 400_000)
    x = spark.createDataFrame([(40.0, 300.0, float(lo), float(lo + 1)) for lo in range(3, 15)], "a DOUBLE, b DOUBLE, days_lo DOUBLE, days_hi DOUBLE")
    for r in x.select("days_lo", P._days_mass(F.col("a"), F.col("b")).alias("mass")).collect():
        assert r["mass"] == pytest.approx(((days > r["days_lo"]) & (days <= r["days_lo"] + 1)).mean(), abs=4e-3)


def test_calibration_rows(air):
    rows = P.account_calibration(air).toPandas()
    summary = S.calibration_summary(air.fork()).first()
    assert len(rows) == summary["n_accounts"] and rows["rank"].between(0, 1).all()
    assert rows["error"].mean() == pytest.approx(summary["mean_error"], abs=1e-7)
    assert (rows["estimate"] <= rows["actual"]).mean() == pytest.approx(summary["share_estimate_below"], abs=1e-7)
    assert P.account_calibration_histogram(air.fork()).agg(F.sum("n")).first()[0] == len(rows)
