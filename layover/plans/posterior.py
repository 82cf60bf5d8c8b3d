"""F2. Posterior distributions of accounts and groups, without sampling.

The rate of a group has a Gamma posterior (``survival.rate_posterior_by_missed``);
so has the rate of an account, given the Gamma population that
``survival.account_rate_shrinkage`` fits by moments.  Whatever the reference
reads off posterior draws -- intervals, the rank of a value among the draws,
histograms of 1/rate -- is read off the distribution function here, so the
results carry no sampling noise and need no draws in memory.

Without overdispersion between accounts (moment variance 0 or less) the
population is a point, and so is every account's posterior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layover.functions.gamma import gamma_cdf, gamma_quantile, gamma_sf
from layover.operators.bounds import attach
from layover.operators.histogram import nice_breaks, with_nice_grid
from layover.operators.spread import spread
from layover.plans.survival import CALIBRATION_CUT, INTERVALS, _per_account, _r, _shrink, _survival_input, before_and_after, rate_posterior_by_missed
from layover.sources.adapter import Airline

BINS = 30
#: tail probabilities at which the grids of implied days end
GROUP_TAIL, ACCOUNT_TAIL = 0.001, 0.05


def account_posteriors(per: DataFrame) -> DataFrame:
    """``per`` with the population (``pop_shape``, ``pop_rate``) and each
    account's Gamma posterior (``shape``, ``rate``); NULL where the population
    is a point."""
    x = _shrink(per)
    mean, var = F.col("pop_mean"), F.col("pop_var")
    x = x.withColumns({"pop_shape": F.when(var > 0, mean * mean / var), "pop_rate": F.when(var > 0, mean / var)})
    return x.withColumns({"shape": F.col("pop_shape") + F.col("events"), "rate": F.col("pop_rate") + F.col("exposure_days")})


def account_rate_interval(air: Airline) -> DataFrame:
    """Exact posterior intervals of every account's booking rate."""
    x = spread(account_posteriors(_per_account(_survival_input(air))), "account_id")
    ends = [_r(F.coalesce(gamma_quantile(F.col("shape"), p) / F.col("rate"), F.col("pop_mean"))).alias(n) for n, p in INTERVALS.items()]
    return x.select("account_id", "events", _r(F.col("exposure_days")).alias("exposure_days"),
                    _r(F.col("shrunk_rate")).alias("shrunk_rate"), *ends)


def account_calibration(air: Airline, cut: str = CALIBRATION_CUT) -> DataFrame:
    """Each account's later booking rate against its posterior as known at
    ``cut``: estimate, error, and the rank of the later rate, that is the
    posterior probability of a rate up to it."""
    before, after = before_and_after(air, cut)
    est = account_posteriors(before)
    act = after.where(F.col("exposure_days") > 0).select(
        "account_id", F.col("events").alias("events_after"), F.col("exposure_days").alias("exposure_after"))
    actual = F.col("events_after") / F.col("exposure_after")
    rank = F.coalesce(gamma_cdf(F.col("shape"), F.col("rate") * actual), F.when(actual >= F.col("pop_mean"), 1.0).otherwise(0.0))
    return spread(est.join(act, "account_id"), "account_id").select(
        "account_id", F.col("events").alias("events_before"), _r(F.col("exposure_days")).alias("exposure_before"),
        _r(F.col("shrunk_rate")).alias("estimate"), "events_after", _r(F.col("exposure_after")).alias("exposure_after"),
        _r(actual).alias("actual"), _r(F.col("shrunk_rate") - actual).alias("error"), _r(rank).alias("rank"))


def account_calibration_histogram(air: Airline, bins: int = BINS, cut: str = CALIBRATION_CUT) -> DataFrame:
    """Histogram of the accounts' ranks: level where the model predicts well."""
    h = nice_breaks(account_calibration(air, cut), "rank", bins)
    return h.select("bin", _r(F.col("bin_lo")).alias("bin_lo"), _r(F.col("bin_hi")).alias("bin_hi"), "n")


def shrunk_rate_breaks(air: Airline, bins: int = BINS) -> DataFrame:
    """Histogram of the shrunk account rates over round break points."""
    h = nice_breaks(_shrink(_per_account(_survival_input(air))), "shrunk_rate", bins)
    return h.select("bin", _r(F.col("bin_lo")).alias("bin_lo"), _r(F.col("bin_hi")).alias("bin_hi"), "n")


def _days_bins(x: DataFrame) -> DataFrame:
    """One row a bin of the grid of days ``_first * _w`` to ``_last * _w``,
    with open bins at both ends (edges ``days_lo`` and ``days_hi`` NULL there)."""
    k = F.col("_k")
    x = x.withColumn("_k", F.explode(F.sequence(F.col("_first") - 1, F.col("_last"))))
    return x.withColumns({"bin": (k - F.col("_first")).cast("int"), "days_lo": F.when(k >= F.col("_first"), k * F.col("_w")),
                          "days_hi": F.when(k < F.col("_last"), (k + 1) * F.col("_w"))})


def _days_mass(shape: Column, rate: Column) -> Column:
    """Posterior probability that 1/rate lies between days_lo and days_hi."""
    upto = lambda t: gamma_sf(shape, F.try_divide(rate, t))
    return F.greatest(F.when(F.col("days_hi").isNull(), 1.0).otherwise(upto(F.col("days_hi")))
                      - F.when(F.col("days_lo").isNull() | (F.col("days_lo") <= 0), 0.0).otherwise(upto(F.col("days_lo"))), F.lit(0.0))


def implied_days_histogram(air: Airline, bins: int = BINS) -> DataFrame:
    """Posterior of the mean days to the next booking (1/rate) after made and
    missed flights, as bin masses on one grid of round break points."""
    p = rate_posterior_by_missed(air).select("missed_flight_flag", F.col("post_shape").alias("shape"), F.col("post_rate").alias("rate"))
    ends = p.agg(F.min(F.col("rate") / gamma_quantile(F.col("shape"), 1 - GROUP_TAIL)).alias("_l"),
                 F.max(F.col("rate") / gamma_quantile(F.col("shape"), GROUP_TAIL)).alias("_h"))
    x = _days_bins(attach(p, with_nice_grid(ends, F.col("_l"), F.col("_h"), bins)))
    return x.select("missed_flight_flag", "bin", _r(F.col("days_lo")).alias("days_lo"), _r(F.col("days_hi")).alias("days_hi"),
                    _r(_days_mass(F.col("shape"), F.col("rate"))).alias("mass"))


def account_implied_days_histogram(air: Airline, bins: int = BINS) -> DataFrame:
    """Mean days to the next booking over accounts: the accounts' posteriors
    of 1/rate mixed in equal parts, for accounts with and without a missed
    flight, on the grid of the population."""
    per = account_posteriors(_per_account(_survival_input(air))).withColumn("has_missed", F.when(F.col("n_missed") > 0, 1).otherwise(0))
    per = per.select("account_id", "has_missed", "shape", "rate", "pop_mean", "pop_shape", "pop_rate")
    per = spread(per, "account_id").checkpoint(eager=True)  # read for the grid and for the masses
    point = 1 / F.col("pop_mean")
    ends = per.agg(F.first("pop_shape").alias("a"), F.first("pop_rate").alias("b"), F.first("pop_mean").alias("pop_mean"))
    low = F.coalesce(F.col("b") / gamma_quantile(F.col("a"), 1 - ACCOUNT_TAIL), 0.5 * point)
    high = F.coalesce(F.col("b") / gamma_quantile(F.col("a"), ACCOUNT_TAIL), 1.5 * point)
    grid = with_nice_grid(ends, low, high, bins).select("_w", "_first", "_last")
    x = attach(per.select("has_missed", "shape", "rate", "pop_mean"), grid)
    # the probability of 1/rate up to each edge, once an edge; the masses are differences of its means
    x = x.withColumn("_k", F.explode(F.sequence(F.col("_first"), F.col("_last") + 1)))
    edge = F.col("_k") * F.col("_w")
    upto = F.when(F.col("_k") > F.col("_last"), 1.0).when(F.col("shape").isNull(), F.when(point <= edge, 1.0).otherwise(0.0))
    upto = upto.when(edge <= 0, 0.0).otherwise(gamma_sf(F.col("shape"), F.try_divide(F.col("rate"), edge)))
    g = x.groupBy("has_missed", "_k", "_w", "_first", "_last").agg(F.count(F.lit(1)).alias("n_accounts"), F.avg(upto).alias("upto"))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("has_missed").orderBy("_k")), F.lit(0.0))  # a row an edge
    return g.select("has_missed", (F.col("_k") - F.col("_first") - 1).cast("int").alias("bin"),
                    _r(F.when(F.col("_k") > F.col("_first"), (F.col("_k") - 1) * F.col("_w"))).alias("days_lo"),
                    _r(F.when(F.col("_k") <= F.col("_last"), edge)).alias("days_hi"), "n_accounts",
                    _r(F.greatest(F.col("upto") - before, F.lit(0.0))).alias("mass"))
