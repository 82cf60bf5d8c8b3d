"""Hierarchical booking-rate model with the account effect integrated out.

Model (the reference's non-centred Stan model, all accounts instead of a
1 % thinning)::

    rate_made(i)   = exp(beta        + tau * eta_i)
    rate_missed(i) = exp(beta_missed + tau * eta_i),   eta_i ~ N(0, 1)
    durations ~ exponential(rate), right-censored
    beta ~ N(m_b, s_b), beta_missed ~ N(m_m, s_m), tau ~ N(m_t, s_t), tau > 0

Each account enters through four sufficient statistics (events d0, d1 and
exposure days T0, T1 after made and missed flights).  The marginal
likelihood of an account integrates eta with adaptive Gauss-Hermite
quadrature, its nodes centred and scaled at the account's mode, so that
accounts with any number of events are integrated exactly; its gradient is the posterior mean of the complete-data gradient, and its
Hessian the posterior mean of the complete-data Hessian plus the
posterior variance of the gradient (Louis' identity).

Spark shape: the per-account statistics are one aggregate, checkpointed
to the shared checkpoint folder (cutting lineage, surviving executor
loss).  Each Newton step is ONE global aggregate over them: the
quadrature is unrolled into flat column expressions inside each row
(JVM-side, whole-stage codegen, no Python UDF) and the map-side partial
sums reduce it to ten numbers, which the driver turns into the next step.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layover.operators.spread import spread
from layover.plans.survival import _account_strata, _r, _survival_input
from layover.sources.adapter import Airline

NODES = 15
NEWTON = 8  # steps to the mode of an account's integrand
TAU_PRIOR = (0.4, 0.1)
BETA_PRIOR_SD = 0.1
MAX_STEP = 0.3
TAU_MIN = 0.001
MAX_ITER = 100  # a fit that needs more raises
TOL = 1e-9  # step size; steps shrink quadratically, so the last one leaves nothing

_FIELDS = ("w", "gb", "gm", "gt", "hbb", "hmm", "htt", "hbt", "hmt", "gbgb", "gmgm", "gtgt", "gbgm", "gbgt", "gmgt")


def _nodes() -> list[tuple[float, float]]:
    """(log weight, standard position) of the nodes before they are centred."""
    x, w = np.polynomial.hermite.hermgauss(NODES)
    return [(float(math.log(wk / math.sqrt(math.pi)) + xk * xk), float(math.sqrt(2.0) * xk)) for xk, wk in zip(x, w)]


def account_stats(air: Airline) -> DataFrame:
    """d0, T0, d1, T1 per account (accounts with any exposure)."""
    return _account_strata(_survival_input(air)).where((F.col("t0") + F.col("t1")) > 0)


def _mode_sql(keep: list[str], more: list[str]) -> list[list[str]]:
    """Layers that find the mode ``_mu`` of an account's eta by Newton steps
    (the integrand is log-concave) and its scale ``_s``, keeping the columns
    ``keep``; ``more`` are kept in the last layer."""
    base = [*keep, "d0", "d1", "t0", "t1", "_b", "_m", "_t"]
    total = [*base, "d0 + d1 AS _d", "t0 * exp(_b) + t1 * exp(_m) AS _e"]
    # start: the account's own log rate, shrunk by its precision
    g = "greatest(_d, 0.5D)"
    start = [*base, "_d", "_e", f"ln({g} / _e) * _t * {g} / (1 + _t * _t * {g}) AS _mu"]
    newton = [*base, "_d", "_e", "_mu - (_mu - _t * _d + _t * _e * exp(_t * _mu)) / (1 + _t * _t * _e * exp(_t * _mu)) AS _mu"]
    scale = [*base, *more, "_mu", "1 / sqrt(1 + _t * _t * _e * exp(_t * _mu)) AS _s"]
    return [total, start, *[newton] * NEWTON, scale]


def _step_sql(nodes: list[tuple[float, float]]) -> list[list[str]]:
    """The per-account quadrature as layers of SQL expressions (built once):
    the mode, then node positions h_k, node exposures e0_k, e1_k,
    log-integrand l_k, the max of l, weights w_k and the weighted sums.
    Intermediates stay columns so expensive terms are computed once.
    """
    K = range(len(nodes))
    keep = ["d0", "d1", "_b", "_m", "_t", "_s"]
    hk = [f"h_{k}" for k in K]
    h = ["t0", "t1"] + [f"_mu + _s * ({z!r}) AS h_{k}" for k, (_, z) in enumerate(nodes)]
    e = [f"t0 * exp(_b + _t * h_{k}) AS e0_{k}" for k in K] + [f"t1 * exp(_m + _t * h_{k}) AS e1_{k}" for k in K]
    ek = [f"e0_{k}" for k in K] + [f"e1_{k}" for k in K]
    ll = [f"({lw!r}) + ln(_s) - 0.5D * h_{k} * h_{k} + d0 * (_b + _t * h_{k}) + d1 * (_m + _t * h_{k}) - e0_{k} - e1_{k} AS l_{k}"
          for k, (lw, _) in enumerate(nodes)]
    mx = "greatest(" + ", ".join(f"l_{k}" for k in K) + ") AS mx"
    w = [f"exp(l_{k} - mx) AS w_{k}" for k in K]
    terms = {
        "w": "w_{k}",
        "gb": "w_{k} * (d0 - e0_{k})",
        "gm": "w_{k} * (d1 - e1_{k})",
        "gt": "w_{k} * h_{k} * (d0 + d1 - e0_{k} - e1_{k})",
        "hbb": "-w_{k} * e0_{k}",
        "hmm": "-w_{k} * e1_{k}",
        "htt": "-w_{k} * h_{k} * h_{k} * (e0_{k} + e1_{k})",
        "hbt": "-w_{k} * h_{k} * e0_{k}",
        "hmt": "-w_{k} * h_{k} * e1_{k}",
        "gbgb": "w_{k} * (d0 - e0_{k}) * (d0 - e0_{k})",
        "gmgm": "w_{k} * (d1 - e1_{k}) * (d1 - e1_{k})",
        "gtgt": "w_{k} * h_{k} * h_{k} * (d0 + d1 - e0_{k} - e1_{k}) * (d0 + d1 - e0_{k} - e1_{k})",
        "gbgm": "w_{k} * (d0 - e0_{k}) * (d1 - e1_{k})",
        "gbgt": "w_{k} * h_{k} * (d0 - e0_{k}) * (d0 + d1 - e0_{k} - e1_{k})",
        "gmgt": "w_{k} * h_{k} * (d1 - e1_{k}) * (d0 + d1 - e0_{k} - e1_{k})",
    }
    sums = [" + ".join(t.format(k=k) for k in K) + f" AS s_{f}" for f, t in terms.items()]
    return [
        *_mode_sql([], []),
        keep + h,
        keep + hk + e,
        keep + hk + ek + ll,
        ["d0", "d1"] + hk + ek + [f"l_{k}" for k in K] + [mx],
        ["d0", "d1", "mx"] + hk + ek + w,
        ["mx"] + sums,
    ]


_SQL = _step_sql(_nodes())


def _step_aggregate(stats: DataFrame, beta: float, beta_m: float, tau: float) -> dict:
    """Sum over accounts of log-likelihood, gradient and Hessian pieces.

    The quadrature is unrolled into flat column expressions (compiled by
    whole-stage codegen); the current parameters come from a one-row
    broadcast frame, so the expressions are identical in every iteration.
    """
    spark = stats.sparkSession
    par = spark.createDataFrame([(float(beta), float(beta_m), float(tau))], "_b DOUBLE, _m DOUBLE, _t DOUBLE")
    x = stats.crossJoin(F.broadcast(par))
    for layer in _SQL:
        x = x.selectExpr(*layer)
    W = F.col("s_w")
    e = {f: F.col("s_" + f) / W for f in _FIELDS[1:]}
    # per-account marginal log-likelihood, gradient and Louis Hessian
    per = x.select(
        (F.col("mx") + F.log(W)).alias("ll"),
        e["gb"].alias("gb"), e["gm"].alias("gm"), e["gt"].alias("gt"),
        (e["hbb"] + e["gbgb"] - e["gb"] * e["gb"]).alias("hbb"),
        (e["hmm"] + e["gmgm"] - e["gm"] * e["gm"]).alias("hmm"),
        (e["htt"] + e["gtgt"] - e["gt"] * e["gt"]).alias("htt"),
        (e["gbgm"] - e["gb"] * e["gm"]).alias("hbm"),
        (e["hbt"] + e["gbgt"] - e["gb"] * e["gt"]).alias("hbt"),
        (e["hmt"] + e["gmgt"] - e["gm"] * e["gt"]).alias("hmt"))
    # without accounts the sums are 0, and the priors alone decide
    row = per.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in per.columns], F.count(F.lit(1)).alias("n")).first()
    return row.asDict()


def fit(stats: DataFrame, priors: dict, start: tuple[float, float, float]) -> dict:
    """Newton iterations on the log posterior of (beta, beta_missed, tau)."""
    mu = np.array([priors["beta"][0], priors["beta_missed"][0], priors["tau"][0]])
    sd = np.array([priors["beta"][1], priors["beta_missed"][1], priors["tau"][1]])
    theta = np.array(start, dtype=float)
    converged, it, s = False, 0, {}
    for it in range(1, MAX_ITER + 1):
        s = _step_aggregate(stats, *theta)
        g = np.array([s["gb"], s["gm"], s["gt"]]) - (theta - mu) / sd ** 2
        h = np.array([[s["hbb"], s["hbm"], s["hbt"]],
                      [s["hbm"], s["hmm"], s["hmt"]],
                      [s["hbt"], s["hmt"], s["htt"]]]) - np.diag(1.0 / sd ** 2)
        vals, vecs = np.linalg.eigh(-h)
        step = vecs @ ((vecs.T @ g) / np.maximum(np.abs(vals), 1e-12))
        big = np.max(np.abs(step))
        if big > MAX_STEP:
            step *= MAX_STEP / big
        theta = theta + step
        theta[2] = max(theta[2], TAU_MIN)
        if np.max(np.abs(step)) < TOL:
            converged = True
            break
    if not converged:
        raise RuntimeError(f"no convergence in {MAX_ITER} Newton steps; last step {big:.3g}")
    s = _step_aggregate(stats, *theta)
    h = np.array([[s["hbb"], s["hbm"], s["hbt"]],
                  [s["hbm"], s["hmm"], s["hmt"]],
                  [s["hbt"], s["hmt"], s["htt"]]]) - np.diag(1.0 / sd ** 2)
    cov = np.linalg.inv(-h)
    g = np.array([s["gb"], s["gm"], s["gt"]]) - (theta - mu) / sd ** 2
    return {"theta": theta, "se": np.sqrt(np.diag(cov)), "grad": g, "iterations": it,
            "converged": converged, "n_accounts": int(s["n"]), "loglik": float(s["ll"])}


def _fitted(air: Airline, beta_prior, beta_missed_prior, tau_prior) -> tuple[DataFrame, dict]:
    """(statistics per account, result of ``fit``).

    Priors on the log-rates default to N(log pooled rate, 0.1): the
    reference's N(-2.1, 0.1) encodes its data's 0.12/day and is passed
    explicitly when wanted.
    """
    stats = spread(account_stats(air), "account_id").checkpoint(eager=True)
    d_, t_ = F.col("d0") + F.col("d1"), F.col("t0") + F.col("t1")
    tot = stats.agg(*[F.sum(c).alias(c) for c in ("d0", "t0", "d1", "t1")],
                    F.sum(d_ * d_).alias("dd"), F.sum(d_ * t_).alias("dt"), F.sum(t_ * t_).alias("tt")).first()
    d, t = (tot["d0"] or 0) + (tot["d1"] or 0), (tot["t0"] or 0) + (tot["t1"] or 0)
    centre = math.log(d / t) if d and t else -2.1

    def log_rate(dd, tt):
        return math.log(dd / tt) if dd and tt else centre

    priors = {"beta": beta_prior or (centre, BETA_PRIOR_SD),
              "beta_missed": beta_missed_prior or (centre, BETA_PRIOR_SD),
              "tau": tau_prior}
    # start from each group's pooled log rate (close to the mode when tau is small)
    # tau from the moments of the account rates: CV^2 = exp(tau^2) - 1 for log-normal rates
    tau0 = tau_prior[0]
    if d and t and tot["tt"]:
        m = d / t
        v = (tot["dd"] - 2 * m * tot["dt"] + m * m * tot["tt"] - d) / tot["tt"]
        tau0 = max(math.sqrt(math.log1p(max(v, 0.0) / (m * m))), TAU_MIN)
    return stats, fit(stats, priors, (log_rate(tot["d0"], tot["t0"]), log_rate(tot["d1"], tot["t1"]), tau0))


def hierarchical_rate_fit(air: Airline, beta_prior: tuple[float, float] | None = None,
                          beta_missed_prior: tuple[float, float] | None = None,
                          tau_prior: tuple[float, float] = TAU_PRIOR) -> DataFrame:
    """Posterior mode and standard errors of beta, beta_missed and tau."""
    _, res = _fitted(air, beta_prior, beta_missed_prior, tau_prior)
    rows = []
    for i, name in enumerate(("beta", "beta_missed", "tau")):
        est, se = float(res["theta"][i]), float(res["se"][i])
        # posterior mean of 1/exp(beta) (the reference's mean(1/exp(beta)) over draws)
        mean_days = math.exp(-est + 0.5 * se * se) if name != "tau" else None
        # the gradient vanishes at the mode; what is left of it is rounding
        rows.append((name, est, se, round(float(res["grad"][i]), 4) + 0.0, mean_days, res["converged"], res["n_accounts"]))
    schema = ("parameter STRING, estimate DOUBLE, std_error DOUBLE, gradient DOUBLE, "
              "mean_days_to_next DOUBLE, converged BOOLEAN, n_accounts BIGINT")
    return air.spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------
# The accounts' own rates
# ---------------------------------------------------------------------------
CELLS = 40  # panels of an account's integration range
REACH = 8  # half-range in standard deviations: the rest is below exp(-32)
WIDEN = 6  # steps of the left half-range, where the integrand falls more slowly
INVERT = 6  # Newton steps to a quantile inside its panel
QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def _gauss() -> tuple[list[float], list[float]]:
    """Positions and weights of five-point Gauss-Legendre panels on (0, 1)."""
    x, w = np.polynomial.legendre.leggauss(5)
    return [float(v + 1) / 2 for v in x], [float(v) / 2 for v in w]


def _density(eta: str) -> str:
    """The account's integrand at ``eta`` relative to its mode."""
    return (f"exp(-0.5D * ({eta} * {eta} - _mu * _mu) + _t * _d * ({eta} - _mu)"
            f" - _e * (exp(_t * {eta}) - exp(_t * _mu)))")


def _account_sql() -> list[list[str]]:
    """Layers from account statistics to moments and quantiles of ``eta``.

    The range around the mode is cut into panels; a panel's mass is a
    five-point Gauss-Legendre sum, its moments likewise.  A quantile lies in
    the panel where the cumulated mass passes it, at the end of the part of
    the panel (by the same sum) that holds what is missing.
    """
    pos, wgt = _gauss()
    own = ["account_id", "d0", "d1", "_b", "_m", "_t", "_d", "_e", "_mu"]
    mode = _mode_sql(["account_id"], ["_d", "_e"])
    reach = [*own, "_s", f"{REACH} * _s AS _l"]
    # the curvature at a distance _l below the mode bounds the fall from there on
    widen = [*own, "_s", f"{REACH} / sqrt(1 + (1 / (_s * _s) - 1) * exp(-_t * _l)) AS _l"]
    span = [*own, "_mu - _l AS _a", f"(_l + {REACH} * _s) / {CELLS} AS _h"]
    points = ", ".join(f"_a + _h * (k + {p!r}D)" for p in pos)
    nodes = [*own, "_a", "_h", f"flatten(transform(sequence(0, {CELLS - 1}), k -> array({points}))) AS _x"]
    weights = "array(" + ", ".join(f"{w!r}D" for w in wgt) + ")"
    dens = [*own, "_a", "_h", "_x", f"transform(_x, (x, i) -> {weights}[i % 5] * {_density('x')}) AS _g"]
    total = "aggregate({}, 0D, (s, v) -> s + v)"
    rise = "zip_with(_g, _x, (g, x) -> g * exp({} * _t * (x - _mu)))"
    cells = ", ".join(f"_g[5 * k + {i}]" for i in range(5)).replace(", ", " + ")
    sums = [*own, "_a", "_h", total.format("_g") + " AS _n", total.format(rise.format(1)) + " AS _m1",
            total.format(rise.format(2)) + " AS _m2", f"transform(sequence(0, {CELLS - 1}), k -> {cells}) AS _c"]
    base = [*own, "_a", "_h"]
    cumulated = [*base, "_n", "_m1 / _n AS _m1", "_m2 / _n AS _m2", "_c",
                 f"transform(sequence(1, {CELLS}), k -> {total.format('slice(_c, 1, k)')}) AS _u"]
    names = list(QUANTILES)
    cell = [*base, "_n", "_m1", "_m2", "_c", "_u",
            *[f"cast(coalesce(array_position(transform(_u, u -> u >= {p!r}D * _n), true), {CELLS}) AS int) - 1 AS _k_{q}" for q, p in QUANTILES.items()]]
    rest = [*base, "_m1", "_m2", *[f"_c[_k_{q}] AS _c_{q}" for q in names], *[f"_a + _h * _k_{q} AS _a_{q}" for q in names],
            *[f"{p!r}D * _n - (_u[_k_{q}] - _c[_k_{q}]) AS _r_{q}" for q, p in QUANTILES.items()]]

    def inverted(q: str) -> str:
        # masses are in units of the panel width, so a part of width v counts v / _h
        part = " + ".join(f"{w!r}D * {_density(f'(_a_{q} + v * {p!r}D)')}" for p, w in zip(pos, wgt))
        step = f"v - (v * ({part}) - _r_{q} * _h) / {_density(f'(_a_{q} + v)')}"
        return f"_a_{q} + aggregate(sequence(1, {INVERT}), _h * _r_{q} / _c_{q}, (v, i) -> greatest(0D, least(_h, {step}))) AS eta_{q}"

    last = ["account_id", "d0", "d1", "_b", "_m", "_t", "_mu", "_m1", "sqrt(greatest(_m2 - _m1 * _m1, 0D)) AS _sd", *[inverted(q) for q in names]]
    return [*mode, reach, *[widen] * WIDEN, span, nodes, dens, sums, cumulated, cell, rest, last]


def account_posterior(stats: DataFrame, beta: float, beta_m: float, tau: float) -> DataFrame:
    """Posterior mean, standard deviation and quantiles of both rates of each
    account of ``stats(account_id, d0, t0, d1, t1)``, given the parameters.

    Both rates are the account's effect times a constant, so one integration
    serves both.  No draws are made and nothing reaches the driver.
    """
    par = stats.sparkSession.createDataFrame([(float(beta), float(beta_m), float(tau))], "_b DOUBLE, _m DOUBLE, _t DOUBLE")
    x = stats.crossJoin(F.broadcast(par))
    for layer in _account_sql():
        x = x.selectExpr(*layer)
    out = []
    for name, b in (("made", "_b"), ("missed", "_m")):
        level = F.exp(F.col(b) + F.col("_t") * F.col("_mu"))
        out += [_r(level * F.col("_m1")).alias(f"{name}_mean"), _r(level * F.col("_sd")).alias(f"{name}_sd"),
                *[_r(F.exp(F.col(b) + F.col("_t") * F.col(f"eta_{q}"))).alias(f"{name}_{q}") for q in QUANTILES]]
    return x.select("account_id", F.col("d0").cast("long").alias("events_made"), F.col("d1").cast("long").alias("events_missed"), *out)


def account_hierarchical_rates(air: Airline, beta_prior: tuple[float, float] | None = None,
                               beta_missed_prior: tuple[float, float] | None = None,
                               tau_prior: tuple[float, float] = TAU_PRIOR) -> DataFrame:
    """Booking rates after made and missed flights of every account with any
    exposure, under the fitted hierarchical model."""
    stats, res = _fitted(air, beta_prior, beta_missed_prior, tau_prior)
    return account_posterior(stats, *res["theta"])
