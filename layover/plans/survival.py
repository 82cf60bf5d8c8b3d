"""F. Survival and booking-rate estimation (re-aimed from the R/Stan fits).

The reference samples posteriors with Stan on a 1 % thinning of accounts
because one parameter per account would not fit in memory.  Every model
it fits is exponential with right-censoring, so the data enter only
through per-group or per-account *sufficient statistics* (event count
``d`` and exposure ``T`` in days).  Here those are Spark aggregates over
all accounts, and the posteriors are closed form:

* Gamma(a0, b0) prior, exponential likelihood -> Gamma(a0 + d, b0 + T)
  exactly (``rate_posterior*``, intervals, survival, quantiles);
* per-account shrinkage with a Gamma population fitted by moments
  (``account_rate_shrinkage``), attached as a one-row broadcast;
* the within-account Mantel-Haenszel rate ratio;
* the hierarchical log-rate model with the account effect integrated out
  (``hierarchical_rate_fit``, see ``layover.plans.hierarchical``).

Nothing is collected except the three parameters of the hierarchical fit
between its iterations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layover.functions.gamma import gamma_quantile
from layover.functions.time import days_between
from layover.operators.bounds import attach, scalar_row
from layover.operators.histogram import equal_width
from layover.operators.ranking import global_index
from layover.operators.selection import exact_quantiles
from layover.plans import retention
from layover.sources.adapter import Airline

# Fixed values of the reference's rate prior: Gamma(shape 0.8, rate 0.33).
PRIOR_SHAPE = 0.8
PRIOR_RATE = 0.33
# Ends of the two-sided intervals and their probabilities.
INTERVALS = {"lower_80": 0.1, "upper_80": 0.9, "lower_95": 0.025, "upper_95": 0.975}
HORIZONS_DAYS = (1.0, 7.0, 30.0, 90.0, 365.0)
SHARES_BOOKED = (0.25, 0.5, 0.75, 0.9)
SAMPLE_FRACTION = 0.01
SAMPLE_SEED = "24"
CALIBRATION_CUT = "1998-07-01 00:00:00"
DECILES = tuple(round(0.1 * i, 1) for i in range(1, 10))
DIGITS = 9  # rounding of values built from floating sums (order-dependent last bits)


def _r(c: Column) -> Column:
    return F.round(c, DIGITS)


# ---------------------------------------------------------------------------
# The survival table with its event time
# ---------------------------------------------------------------------------
def survival_events(air: Airline) -> DataFrame:
    """The exported survival events (with the arrival that starts each duration)."""
    return retention.survival_export(air)


def _survival_input(air: Airline) -> DataFrame:
    """The survival table the models read: the export, without the arrival time."""
    return retention.survival_export(air).drop("actual_arrival")


def _events(df: DataFrame) -> Column:
    return F.sum(F.when(F.col("censored_id") == 0, 1).otherwise(0)).cast("long")


def _conjugate(s: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Posterior columns of rows with ``n_events``, ``n_censored`` and
    ``exposure_days``; without any data (NULL sums) it is the prior."""
    n_events, n_censored = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_events", "n_censored"))
    exposure = F.coalesce(F.col("exposure_days"), F.lit(0.0))
    s = s.select(*keys, n_events.alias("n_events"), n_censored.alias("n_censored"), exposure.alias("exposure_days"))
    a = F.lit(PRIOR_SHAPE) + F.col("n_events")
    b = F.lit(PRIOR_RATE) + F.col("exposure_days")
    return s.select(*keys, "n_events", "n_censored", _r(F.col("exposure_days")).alias("exposure_days"),
                    a.alias("post_shape"), _r(b).alias("post_rate"), _r(a / b).alias("rate_mean"),
                    _r(F.sqrt(a) / b).alias("rate_sd"),
                    _r(F.when(a > 1, b / (a - 1))).alias("mean_days_to_next"))


# ---------------------------------------------------------------------------
# Jobs
# ---------------------------------------------------------------------------
def mean_days_to_next(air: Airline) -> DataFrame:
    st = _survival_input(air)
    return st.agg(F.count(F.lit(1)).alias("n_rows"), _r(F.avg("days")).alias("mean_days"))


def rate_posterior(air: Airline) -> DataFrame:
    """Pooled booking rate: exact Gamma posterior under right-censoring."""
    censored = F.col("censored_id")
    return _conjugate(_survival_input(air).agg(
        F.sum(F.when(censored == 0, 1)).alias("n_events"), F.sum(F.when(censored == 1, 1)).alias("n_censored"),
        F.sum("days").alias("exposure_days")))


def rate_posterior_by_missed(air: Airline) -> DataFrame:
    """Booking rate after a made (0) and a missed (1) flight, each with its own
    censored exposure.  One aggregate holds both groups, so a group without
    rows is there too, with the prior as its posterior."""
    flag, censored = F.col("missed_flight_flag"), F.col("censored_id")
    sums = _survival_input(air).agg(F.array(*[F.struct(
        F.lit(m).cast("int").alias("missed_flight_flag"),
        F.sum(F.when((flag == m) & (censored == 0), 1)).alias("n_events"),
        F.sum(F.when((flag == m) & (censored == 1), 1)).alias("n_censored"),
        F.sum(F.when(flag == m, F.col("days"))).alias("exposure_days")) for m in (0, 1)]).alias("groups"))
    return _conjugate(sums.selectExpr("inline(groups)"), ["missed_flight_flag"])


def rate_interval(air: Airline) -> DataFrame:
    """Exact two-sided intervals of the booking rate after made and missed flights."""
    p = rate_posterior_by_missed(air)
    a, b = F.col("post_shape"), F.col("post_rate")
    return p.select("missed_flight_flag", "rate_mean",
                    *[_r(gamma_quantile(a, q) / b).alias(name) for name, q in INTERVALS.items()])


def mean_time_to_next(air: Airline) -> DataFrame:
    """Posterior mean of 1/rate (mean days to the next booking) per group."""
    p = rate_posterior_by_missed(air)
    return p.select("missed_flight_flag", "mean_days_to_next")


def survival_at_horizon(air: Airline, horizons: Sequence[float] = HORIZONS_DAYS) -> DataFrame:
    """Share not yet booked after t days: at the posterior mean rate, and
    posterior-predictive (b / (b + t))^a."""
    p = rate_posterior_by_missed(air)
    x = p.withColumn("horizon_days", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    t, a, b = F.col("horizon_days"), F.col("post_shape"), F.col("post_rate")
    return x.select("missed_flight_flag", "horizon_days",
                    _r(F.exp(-F.col("rate_mean") * t)).alias("survival_at_mean_rate"),
                    _r(F.pow(b / (b + t), a)).alias("survival_predictive"))


def time_quantile(air: Airline, shares: Sequence[float] = SHARES_BOOKED) -> DataFrame:
    """Days by which a share u of customers has booked again (inverse survival)."""
    p = rate_posterior_by_missed(air)
    x = p.withColumn("share_booked", F.explode(F.array(*[F.lit(float(u)) for u in shares])))
    u, a, b = F.col("share_booked"), F.col("post_shape"), F.col("post_rate")
    return x.select("missed_flight_flag", "share_booked",
                    _r(-F.log(F.lit(1.0) - u) / F.col("rate_mean")).alias("days_at_mean_rate"),
                    _r(b * (F.pow(F.lit(1.0) - u, -F.lit(1.0) / a) - 1)).alias("days_predictive"))


def _per_account(st: DataFrame) -> DataFrame:
    return st.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("missed_flight_flag").cast("long").alias("n_missed"),
        _events(st).alias("events"),
        F.sum("days").alias("exposure_days"))


def account_flights_by_missed(air: Airline) -> DataFrame:
    """Mean rows (flights) per account: accounts with no, one, and more missed flights."""
    acc = _per_account(_survival_input(air))
    g = F.when(F.col("n_missed") > 1, "more_missed").when(F.col("n_missed") == 1, "one_missed").otherwise("none_missed")
    return acc.groupBy(g.alias("accounts")).agg(F.count(F.lit(1)).alias("n_accounts"),
                                                _r(F.avg("n_rows")).alias("mean_flights"))


def missed_accounts(air: Airline) -> DataFrame:
    """All rows of accounts with at least one missed flight."""
    st = _survival_input(air)
    m = st.where(F.col("missed_flight_flag") == 1).select("account_id").distinct()
    return st.join(m, "account_id", "left_semi")


def account_index(air: Airline) -> DataFrame:
    """Dense 1..K index of the accounts of the survival table (by account id)."""
    acc = _survival_input(air).select("account_id").distinct()
    return global_index(acc, ["account_id"], out="account_index")


def account_sample(air: Airline, fraction: float = SAMPLE_FRACTION, seed: str = SAMPLE_SEED) -> DataFrame:
    """Rows of all accounts with a missed flight plus those of the rest that
    fall in a fixed-size sample (round(fraction x K) accounts of all K, ranked
    by ``md5(account_id:seed)``: repeatable and independent of partitioning)."""
    st = _survival_input(air)
    acc = _per_account(st).select("account_id", "n_missed")
    h = acc.withColumn("_h", F.md5(F.concat(F.col("account_id").cast("string"), F.lit(":" + seed))))
    ranked = global_index(h, ["_h", "account_id"], out="_rank")
    k = scalar_row(acc, _k=F.round(F.count(F.lit(1)) * F.lit(float(fraction))).cast("long"))
    keep = attach(ranked, k).where((F.col("n_missed") >= 1) | (F.col("_rank") <= F.col("_k")))
    return st.join(keep.select("account_id"), "account_id", "left_semi")


def stratum_sufficient_stats(air: Airline) -> DataFrame:
    """Rows and exposure in the four strata observed/censored x made/missed."""
    st = _survival_input(air)
    return st.groupBy("censored_id", "missed_flight_flag").agg(
        F.count(F.lit(1)).alias("n_rows"), _r(F.sum("days")).alias("exposure_days"))


def _shrink(per: DataFrame) -> DataFrame:
    """Gamma population by moments over accounts; posterior mean per account."""
    d, t = F.col("events").cast("double"), F.col("exposure_days")
    x = attach(per, per.agg((F.sum(d) / F.sum(t)).alias("pop_mean")))
    gap = d - F.col("pop_mean") * t
    # centred sums: the expanded form cancels and its squares of counts overflow
    x = attach(x, x.agg((F.sum(gap * gap - d) / F.sum(t * t)).alias("pop_var")))
    alpha = F.col("pop_mean") * F.col("pop_mean") / F.col("pop_var")
    beta = F.col("pop_mean") / F.col("pop_var")
    shrunk = F.when(F.col("pop_var") > 0, (alpha + d) / (beta + t)).otherwise(F.col("pop_mean"))
    return x.withColumn("shrunk_rate", shrunk)


def account_rate_shrinkage(air: Airline) -> DataFrame:
    """Per-account booking rate shrunk to the population (all accounts)."""
    per = _per_account(_survival_input(air))
    x = _shrink(per)
    return x.select("account_id", "events", _r(F.col("exposure_days")).alias("exposure_days"),
                    _r(F.try_divide(F.col("events"), F.col("exposure_days"))).alias("raw_rate"),
                    _r(F.col("shrunk_rate")).alias("shrunk_rate"))


def _account_strata(st: DataFrame) -> DataFrame:
    made, missed = F.col("missed_flight_flag") == 0, F.col("missed_flight_flag") == 1
    ev = F.col("censored_id") == 0
    return st.groupBy("account_id").agg(
        F.sum(F.when(made & ev, 1).otherwise(0)).cast("double").alias("d0"),
        F.sum(F.when(made, F.col("days")).otherwise(0.0)).alias("t0"),
        F.sum(F.when(missed & ev, 1).otherwise(0)).cast("double").alias("d1"),
        F.sum(F.when(missed, F.col("days")).otherwise(0.0)).alias("t1"))


def stratified_rate_ratio(air: Airline) -> DataFrame:
    """Mantel-Haenszel missed/made rate ratio within accounts."""
    s = _account_strata(_survival_input(air))
    tot = F.col("t0") + F.col("t1")
    num = F.when(tot > 0, F.col("d1") * F.col("t0") / tot).otherwise(0.0)
    den = F.when(tot > 0, F.col("d0") * F.col("t1") / tot).otherwise(0.0)
    both = (F.col("t0") > 0) & (F.col("t1") > 0)
    r = s.agg(F.sum(num).alias("_n"), F.sum(den).alias("_d"),
              F.sum(F.when(both, 1).otherwise(0)).cast("long").alias("n_accounts_both"))
    return r.select("n_accounts_both", _r(F.try_divide(F.col("_n"), F.col("_d"))).alias("rate_ratio"))


#: replicates of the bootstrap, and what its draws are hashed with
REPLICATES, BOOTSTRAP_SEED = 200, "b"
#: distribution function of Poisson(1) at 0, 1, 2, ...: a uniform value past
#: the kth of them is a weight above k
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(10))


def bootstrap_ratios(per: DataFrame, replicates: int = REPLICATES, seed: str = BOOTSTRAP_SEED, keys: Sequence[str] = ()) -> DataFrame:
    """``per(account_id, num, den)`` -> (keys..., replicate, ratio): sums of num
    over sums of den with every account weighted by a Poisson(1) number, its
    own in each replicate.

    The weight is a function of a hash of (account, replicate), so replicates
    do not depend on partitioning; the sums of all replicates are one partial
    aggregate, whose map side emits one row a replicate and task."""
    x = per.select(*keys, "account_id", "num", "den", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    text = F.concat(F.col("account_id").cast("string"), F.lit(":"), F.col("replicate").cast("string"), F.lit(":" + seed))
    u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    x = x.withColumn("w", weight).where("w > 0")
    g = x.groupBy(*keys, "replicate").agg(F.sum(F.col("w") * F.col("num")).alias("n"), F.sum(F.col("w") * F.col("den")).alias("d"))
    return g.select(*keys, "replicate", F.try_divide("n", "d").alias("ratio"))


def _ratio_terms(s: DataFrame) -> DataFrame:
    """Each account's terms of the Mantel-Haenszel ratio, where it has any."""
    tot = F.col("t0") + F.col("t1")
    term = lambda d, t: F.coalesce(F.try_divide(F.col(d) * F.col(t), tot), F.lit(0.0))
    return s.select("account_id", term("d1", "t0").alias("num"), term("d0", "t1").alias("den")).where("num > 0 or den > 0")


def rate_ratio_interval(air: Airline, replicates: int = REPLICATES) -> DataFrame:
    """The missed/made rate ratio with its uncertainty: a bootstrap of whole
    accounts, so that an account's durations stay together."""
    per = _ratio_terms(_account_strata(_survival_input(air)))
    ratio = per.agg(F.count(F.lit(1)).alias("n_accounts"), _r(F.try_divide(F.sum("num"), F.sum("den"))).alias("rate_ratio"))
    b = bootstrap_ratios(per, replicates)
    ends = F.percentile("ratio", F.array(*[F.lit(p) for p in INTERVALS.values()]))
    spread = b.agg(F.count("ratio").alias("replicates"), _r(F.stddev_samp("ratio")).alias("std_error"), ends.alias("_e"))
    x = attach(ratio, spread)
    return x.select("n_accounts", "rate_ratio", "replicates", "std_error", *[_r(F.col("_e")[i]).alias(n) for i, n in enumerate(INTERVALS)])


def rate_deciles(air: Airline, probs: Sequence[float] = DECILES) -> DataFrame:
    """Deciles of the shrunk account rates (linear interpolation, exact)."""
    r = account_rate_shrinkage(air)
    q = exact_quantiles(r, "shrunk_rate", probs)
    return q.select("q", "p", _r(F.col("quantile")).alias("quantile"))


def posterior_histogram(air: Airline, bins: int = 30) -> DataFrame:
    """Histogram of shrunk account rates, by whether the account missed a flight."""
    st = _survival_input(air)
    per = _shrink(_per_account(st)).withColumn(
        "has_missed", F.when(F.col("n_missed") > 0, 1).otherwise(0))
    h = equal_width(per, "shrunk_rate", bins, group="has_missed")
    return h.select("has_missed", "bin", _r(F.col("bin_lo")).alias("bin_lo"), _r(F.col("bin_hi")).alias("bin_hi"),
                    "n")


def before_and_after(air: Airline, cut: str) -> tuple[DataFrame, DataFrame]:
    """Sums per account of the durations as known at ``cut`` (those still open
    then are censored there), and of the durations that start later."""
    ev = survival_events(air).withColumn("_cut", F.lit(cut).cast("timestamp_ntz"))
    known = days_between("_cut", "actual_arrival")
    before = ev.where(F.col("actual_arrival") < F.col("_cut")).withColumns({
        "censored_id": F.when(F.col("days") > known, 1).otherwise(F.col("censored_id")),
        "days": F.least(F.col("days"), known)})
    after = ev.where(F.col("actual_arrival") >= F.col("_cut"))
    return _per_account(before), _per_account(after)


def calibration_summary(air: Airline, cut: str = CALIBRATION_CUT) -> DataFrame:
    """Predict each account's later booking rate from what is known at ``cut``
    of its durations (shrunk estimate), compare with events/exposure of
    durations that start later."""
    before, after = before_and_after(air, cut)
    est = _shrink(before).select("account_id", F.col("shrunk_rate").alias("estimate"))
    act = after.where(F.col("exposure_days") > 0).select(
        "account_id", (F.col("events") / F.col("exposure_days")).alias("actual"))
    j = est.join(act, "account_id", "inner").withColumn("error", F.col("estimate") - F.col("actual"))
    return j.agg(
        F.count(F.lit(1)).alias("n_accounts"),
        _r(F.avg("error")).alias("mean_error"),
        _r(F.avg(F.abs("error")) / F.avg(F.abs("actual"))).alias("relative_abs_error"),
        _r(F.avg(F.when(F.col("estimate") <= F.col("actual"), 1.0).otherwise(0.0))).alias("share_estimate_below"))
