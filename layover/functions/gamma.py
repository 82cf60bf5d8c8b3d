"""Gamma distribution as column expressions (no Python in the tasks).

``P(a, x)`` is the regularised lower incomplete gamma function, the
distribution function of a Gamma variable of shape ``a`` and rate 1.  Below
``x = a + 1`` it is summed as a series of positive terms, above it is one
minus a continued fraction.  Both are folds over
``terms(a)`` steps: near ``x = a`` the terms fall like ``exp(-n^2 / 2a)``, so
``9 sqrt(a) + 60`` steps leave out less than 1e-16 of the sum for any ``a``.
Both are evaluated from their end, so that a step is one small expression
without state.  Their common factor ``x^a exp(-x) / Gamma(a + 1)`` is taken
relative to its peak for large ``a``, where the plain product would lose all
its digits.

Quantiles are found by Newton steps in ``ln x`` inside a bracket; a step that
leaves the bracket halves it instead.  A row stops computing once the error
that the square of its last step leaves is below rounding.

Shapes must be positive (else NULL); NULLs give NULL; ``x <= 0`` gives 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: coefficients 1/12, -1/360, ... of Stirling's series for ln Gamma
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
#: shapes from here on use Stirling's series directly, smaller ones shift to it
LARGE = 10
STEPS = 100


def bind(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct whose fields are computed once."""
    one = F.array(F.struct(*[c.alias(n) for n, c in values.items()]))
    return F.element_at(F.transform(one, body), 1)


def _tail(a: Column) -> Column:
    """ln Gamma(a + 1) - ln(sqrt(2 pi a) (a / e)^a), for a of LARGE or more."""
    s, inv = F.lit(0.0), 1 / (a * a)
    for c in reversed(STIRLING):
        s = s * inv + F.lit(c)
    return s / a


def log_gamma(a: Column) -> Column:
    """ln Gamma(a) of a positive ``a``."""
    shifted = a + float(LARGE)
    product = F.lit(1.0)
    for k in range(LARGE):
        product = product * (a + float(k))
    stirling = lambda y: (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + _tail(y)
    return F.when(a >= LARGE, stirling(a)).when(a > 0, stirling(shifted) - F.log(product))


def _factor(a: Column, x: Column) -> Column:
    """x^a exp(-x) / Gamma(a + 1) of a positive ``x``."""
    u = (x - a) / a
    large = F.exp(-a * (u - F.log1p(u)) - _tail(a)) / F.sqrt(2 * math.pi * a)
    return F.when(a >= LARGE, large).otherwise(F.exp(a * F.log(x) - x - log_gamma(a + 1)))


def _enough(a: Column) -> Column:
    return 9 * F.sqrt(a) + 60


def terms(a: Column) -> Column:
    return F.ceil(_enough(a)).cast("int")


def _series(a: Column, x: Column) -> Column:
    """1 + x/(a+1) (1 + x/(a+2) (1 + ...)); for x < a + 1.  The terms also fall
    at least like (x / (a+1))^n, which ends the sum early far below the mean.
    (Close to a + 1 that number has no bound, so the smaller one is taken first.)"""
    n = F.ceil(F.least(_enough(a), F.try_divide(F.lit(40.0), F.log((a + 1) / x)) + 1)).cast("int")
    return F.aggregate(F.sequence(n, F.lit(1)), F.lit(1.0), lambda s, k: 1 + s * x / (a + k))


def _fraction(a: Column, x: Column) -> Column:
    """x + 1 - a + 1 (a-1) / (x + 3 - a + 2 (a-2) / (...)); for x >= a + 1."""
    n = terms(a)
    return F.aggregate(F.sequence(n, F.lit(1)), x + 2 * n + 1 - a, lambda f, k: x + 2 * k - 1 - a + k * (a - k) / f)


def _cdf(a: Column, x: Column, factor: Column, upper: bool = False) -> Column:
    """P, or 1 - P if ``upper``, given the common factor."""
    low, high = factor * _series(a, x), factor * a / _fraction(a, x)
    return F.when(x < a + 1, 1 - low if upper else low).otherwise(high if upper else 1 - high)


def _guarded(a: Column, x: Column, upper: bool) -> Column:
    at_zero = 1.0 if upper else 0.0
    inner = bind(lambda s: _cdf(s["a"], s["x"], _factor(s["a"], s["x"]), upper), a=a.cast("double"), x=x.cast("double"))
    return (F.when(a.isNull() | x.isNull() | (a <= 0), None).when(x <= 0, at_zero)
            .when(x == float("inf"), 1 - at_zero).otherwise(inner))


def gamma_cdf(a: Column, x: Column) -> Column:
    """P(a, x): probability that Gamma(a, rate 1) is at most ``x``."""
    return _guarded(a, x, upper=False)


def gamma_sf(a: Column, x: Column) -> Column:
    """1 - P(a, x), without loss of digits in the upper tail."""
    return _guarded(a, x, upper=True)


def _start(a: Column, p: float) -> Column:
    z = NormalDist().inv_cdf(p)
    cube = 1 - 1 / (9 * a) + z / (3 * F.sqrt(a))
    small = F.exp((math.log(p) + log_gamma(a + 1)) / a)
    return F.greatest(F.when((a < 1) | (cube < 0.4), small).otherwise(a * cube * cube * cube), F.lit(1e-300))


def gamma_quantile(a: Column, p: float) -> Column:
    """The value that Gamma(a, rate 1) does not exceed with probability ``p``."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")

    def solve(s: Column) -> Column:
        a = s["a"]

        def settled(old: Column, new: Column) -> Column:
            moved_by = (new - old) / old
            return moved_by * moved_by * (1 + F.abs(a - new)) <= 1e-15

        def step(acc: Column, _: Column) -> Column:
            def moved(v: Column) -> Column:
                lo = F.when(v["cdf"] < p, acc["x"]).otherwise(acc["lo"])
                hi = F.when(v["cdf"] < p, acc["hi"]).otherwise(acc["x"])
                newton = acc["x"] * F.exp(F.greatest(F.least(F.try_divide(p - v["cdf"], a * v["factor"]), F.lit(2.0)), F.lit(-2.0)))
                half = F.when(hi == float("inf"), 8 * lo).when(lo == 0, hi / 8).otherwise((lo + hi) / 2)
                good = (v["factor"] > 0) & (newton > lo) & (newton < hi)
                x = F.when(v["cdf"] == p, acc["x"]).when(good, newton).otherwise(half)
                return bind(lambda w: F.struct(w["x"].alias("x"), w["lo"].alias("lo"), w["hi"].alias("hi"),
                                               settled(acc["x"], w["x"]).alias("done")), x=x, lo=lo, hi=hi)

            factor = _factor(a, acc["x"])
            go = bind(lambda f: bind(moved, factor=f["f"], cdf=_cdf(a, acc["x"], f["f"])), f=factor)
            return F.when(acc["done"], acc).otherwise(go)

        start = F.struct(_start(a, p).alias("x"), F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc["x"])

    return F.when(a > 0, bind(solve, a=a.cast("double")))
