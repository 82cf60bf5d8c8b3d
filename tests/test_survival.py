"""Closed-form estimators recover known rates (mirrors the reference's
simulation checks) and the hierarchical fit behaves (SURVEY 5.2.2, 5.2.4)."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from layover.plans import hierarchical as H
from layover.plans import survival as S

SCHEMA = "account_id LONG, missed_flight_flag INT, censored_id INT, days DOUBLE"


def _censored_exponential(rng, n, rate, cens):
    t = rng.exponential(1 / rate, n)
    c = np.asarray(cens if np.ndim(cens) else np.full(n, cens), dtype=float)
    return np.minimum(t, c), (t > c).astype(int)


@pytest.mark.parametrize("rate,cens", [(0.40, 2.5), (0.60, "variable")])
def test_rate_posterior_recovers_known_rate(spark, rate, cens):
    rng = np.random.default_rng(7)
    n = 4000
    c = 3.5 + rng.normal(0, 0.5, n) if cens == "variable" else cens
    days, censored = _censored_exponential(rng, n, rate, c)
    rows = [(i, 0, int(ci), float(d)) for i, (d, ci) in enumerate(zip(days, censored))]
    sums = spark.createDataFrame(rows, SCHEMA).agg(F.count_if(F.col("censored_id") == 0).alias("n_events"),
                                                   F.count_if(F.col("censored_id") == 1).alias("n_censored"),
                                                   F.sum("days").alias("exposure_days"))
    post = S._conjugate(sums).first()
    assert abs(post["rate_mean"] - rate) < 3 * post["rate_sd"]
    assert post["n_events"] + post["n_censored"] == n


def test_shrinkage_falls_back_to_pooled_rate_without_overdispersion(spark):
    # identical accounts: moment variance <= 0, every account gets the pooled rate
    per = spark.createDataFrame([(i, 2, 10.0) for i in range(20)], "account_id LONG, events LONG, exposure_days DOUBLE")
    out = S._shrink(per).select("shrunk_rate").distinct().collect()
    assert len(out) == 1 and out[0][0] == pytest.approx(0.2)


def test_stratified_ratio_is_null_without_missed_exposure(spark):
    st = spark.createDataFrame([(1, 0, 0, 3.0), (2, 0, 1, 4.0)], SCHEMA)
    s = S._account_strata(st)
    tot = F.col("t0") + F.col("t1")
    r = s.agg(F.sum(F.when(tot > 0, F.col("d1") * F.col("t0") / tot).otherwise(0.0)).alias("n"),
              F.sum(F.when(tot > 0, F.col("d0") * F.col("t1") / tot).otherwise(0.0)).alias("d")) \
        .select(F.try_divide("n", "d").alias("r")).first()
    assert r["r"] is None


def _simulate_accounts(rng, k, beta, beta_m, tau, horizon=30.0):
    rows = []
    for i in range(k):
        eta = rng.normal()
        for flag, b in ((0, beta), (1, beta_m)):
            lam = math.exp(b + tau * eta)
            for _ in range(rng.integers(1, 4)):
                t = rng.exponential(1 / lam)
                rows.append((i, flag, int(t > horizon), float(min(t, horizon))))
    return rows


def test_hierarchical_fit_recovers_parameters(spark):
    rng = np.random.default_rng(3)
    rows = _simulate_accounts(rng, 3000, -2.1, -1.9, 0.4)
    stats = S._account_strata(spark.createDataFrame(rows, SCHEMA)).checkpoint(eager=True)
    flat = {"beta": (-2.0, 10.0), "beta_missed": (-2.0, 10.0), "tau": (0.5, 10.0)}
    res = H.fit(stats, flat, (-2.0, -2.0, 0.5))
    assert res["converged"]
    assert np.max(np.abs(res["grad"])) < 1e-4
    for est, true, se in zip(res["theta"], (-2.1, -1.9, 0.4), res["se"]):
        assert abs(est - true) < 3 * se + 1e-9, (est, true, se)


@pytest.mark.parametrize("d0,d1,t0,t1", [(0, 0, 30.0, 0.0), (1, 0, 5.0, 9000.0), (60, 40, 500.0, 300.0),
                                         (7000, 3000, 40000.0, 30000.0)])
def test_quadrature_agrees_with_dense_integration(spark, d0, d1, t0, t1):
    b, m, t = -2.0, -1.8, 0.4
    eta = np.linspace(-25, 25, 2_000_001)
    e0, e1 = t0 * np.exp(b + t * eta), t1 * np.exp(m + t * eta)
    log = -0.5 * eta * eta + d0 * (b + t * eta) + d1 * (m + t * eta) - e0 - e1
    w = np.exp(log - log.max())
    mean = lambda x: float((w * x).sum() / w.sum())
    stats = spark.createDataFrame([(float(d0), t0, float(d1), t1)], "d0 DOUBLE, t0 DOUBLE, d1 DOUBLE, t1 DOUBLE")
    got = H._step_aggregate(stats, b, m, t)
    gt = eta * (d0 + d1 - e0 - e1)
    assert got["ll"] == pytest.approx(math.log(w.sum() * (eta[1] - eta[0]) / math.sqrt(2 * math.pi)) + log.max(), rel=1e-8)
    assert got["gb"] == pytest.approx(mean(d0 - e0), rel=1e-5, abs=1e-5)
    assert got["gm"] == pytest.approx(mean(d1 - e1), rel=1e-5, abs=1e-5)
    assert got["gt"] == pytest.approx(mean(gt), rel=1e-5, abs=1e-5)
    htt = mean(-eta * eta * (e0 + e1)) + mean(gt * gt) - mean(gt) ** 2
    assert got["htt"] == pytest.approx(htt, rel=1e-4, abs=1e-4)


def test_hierarchical_tau_to_zero_gives_pooled_rate(spark):
    rng = np.random.default_rng(5)
    rows = _simulate_accounts(rng, 800, -2.0, -2.0, 0.0)
    df = spark.createDataFrame(rows, SCHEMA)
    stats = S._account_strata(df).checkpoint(eager=True)
    pri = {"beta": (-2.0, 10.0), "beta_missed": (-2.0, 10.0), "tau": (0.001, 1e-4)}
    res = H.fit(stats, pri, (-2.0, -2.0, 0.001))
    made = df.where("missed_flight_flag = 0").agg(
        F.sum(F.when(F.col("censored_id") == 0, 1).otherwise(0)).alias("d"), F.sum("days").alias("t")).first()
    assert res["theta"][0] == pytest.approx(math.log(made["d"] / made["t"]), abs=1e-3)


@pytest.mark.parametrize("beta,missed,tau", [(-2.0, -1.8, 0.4), (-1.0, -3.0, 1.2), (-2.5, -2.4, 0.02)])
def test_account_posterior_agrees_with_dense_integration(spark, beta, missed, tau):
    accounts = [(1, 0.0, 30.0, 0.0, 0.0), (2, 0.0, 0.5, 0.0, 9000.0), (3, 1.0, 5.0, 0.0, 0.0), (4, 0.0, 0.0, 4.0, 2.0), (5, 60.0, 500.0, 40.0, 300.0),
                (6, 7000.0, 40000.0, 3000.0, 30000.0), (7, 0.0, 5000.0, 0.0, 0.0), (8, 30.0, 1.0, 0.0, 0.0)]
    stats = spark.createDataFrame(accounts, "account_id LONG, d0 DOUBLE, t0 DOUBLE, d1 DOUBLE, t1 DOUBLE")
    got = {r["account_id"]: r for r in H.account_posterior(stats, beta, missed, tau).collect()}
    assert len(got) == len(accounts)
    for i, d0, t0, d1, t1 in accounts:
        log = lambda eta: -0.5 * eta * eta + tau * (d0 + d1) * eta - (t0 * math.exp(beta) + t1 * math.exp(missed)) * np.exp(tau * eta)  # noqa: B023,E731
        wide = np.linspace(-40, 40, 400_001)
        near = wide[log(wide) > log(wide).max() - 40]
        eta = np.linspace(near[0] - 1e-3, near[-1] + 1e-3, 1_000_001)
        w = np.exp(log(eta) - log(eta).max())
        cum = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2)))
        for name, b in (("made", beta), ("missed", missed)):
            rate = np.exp(b + tau * eta)
            mean = (w * rate).sum() / w.sum()
            assert got[i][f"{name}_mean"] == pytest.approx(mean, rel=1e-7, abs=1e-9)
            assert got[i][f"{name}_sd"] == pytest.approx(math.sqrt((w * (rate - mean) ** 2).sum() / w.sum()), rel=1e-5, abs=2e-9)
            for q, p in H.QUANTILES.items():
                assert got[i][f"{name}_{q}"] == pytest.approx(float(np.interp(p * cum[-1], cum, rate)), rel=1e-7, abs=1e-9)


def test_account_rates_recover_simulated_rates(spark):
    rng = np.random.default_rng(12)
    eta = rng.normal(size=1500)
    rows, true = [], {}
    for i, e in enumerate(eta):
        true[i] = math.exp(-2.0 + 0.5 * e)
        for _ in range(rng.integers(1, 6)):
            t = rng.exponential(1 / true[i])
            rows.append((i, 0, int(t > 30), float(min(t, 30.0))))
    stats = S._account_strata(spark.createDataFrame(rows, SCHEMA))
    got = H.account_posterior(stats, -2.0, -2.0, 0.5).toPandas().set_index("account_id")
    real = np.array([true[i] for i in got.index])
    for q, p in H.QUANTILES.items():
        assert abs((real < got[f"made_{q}"]).mean() - p) < 0.03
    assert abs((real - got["made_mean"]).mean()) < 0.01
