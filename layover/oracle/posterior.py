"""Oracle SQL for the posterior distributions of accounts and groups.

The distribution function is summed term by term here, each term from
``lgamma`` alone; quantiles are found by halving an interval.  (The jobs use
a continued fraction above the mean, and Newton steps.)
"""

from layover.oracle.survival import BEFORE_AFTER, PER, POST, SHRINK, R, _q

TAILS = [("lower_80", 0.1), ("upper_80", 0.9), ("lower_95", 0.025), ("upper_95", 0.975)]


def cdf(a: str, x: str) -> str:
    """P(Gamma(a) <= x)."""
    return f"""(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} > {a} + 40 * sqrt({a}) + 300 THEN 1.0 ELSE
    list_sum(list_transform(range(0, CAST(ceil(greatest({x} - {a}, 0) + 12 * sqrt({x} + {a}) + 80) AS BIGINT)),
             lambda n: exp(({a} + n) * ln({x}) - {x} - lgamma({a} + n + 1)))) END)"""


def quantiles(wanted: str, name: str = "qs") -> str:
    """CTEs: rows of ``wanted(key, a, p)`` with the quantile ``x``."""
    return f"""
{name}_halved(key, a, p, lo, hi, k) AS (
  SELECT key, CAST(a AS DOUBLE), CAST(p AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(a + 14 * sqrt(a) + 60 AS DOUBLE), 0 FROM ({wanted})
  UNION ALL
  SELECT key, a, p, CASE WHEN c < p THEN mid ELSE lo END, CASE WHEN c < p THEN hi ELSE mid END, k + 1
  FROM (SELECT *, {cdf('a', 'mid')} AS c FROM (SELECT *, (lo + hi) / 2 AS mid FROM {name}_halved WHERE k < 75))
),
{name} AS (SELECT key, a, p, (lo + hi) / 2 AS x FROM {name}_halved WHERE k = 75)"""


GAMMAS = """
gam AS (
  SELECT shr.*, CASE WHEN pop_var > 0 THEN pop_mean * pop_mean / pop_var END AS pop_a, CASE WHEN pop_var > 0 THEN pop_mean / pop_var END AS pop_b, pop_mean
  FROM shr CROSS JOIN mom
)"""


def width(lo: str, hi: str, n: int) -> str:
    """Width of the break rule as a scalar subquery over one row."""
    return f"""(SELECT CASE WHEN c <= 0 THEN 0.0
      WHEN 10 * u - c < 1.5 * (c - 5 * u) AND 5 * u - c < 2.75 * (c - 2 * u) AND 2 * u - c < 1.5 * (c - u) THEN 10 * u
      WHEN 5 * u - c < 2.75 * (c - 2 * u) AND 2 * u - c < 1.5 * (c - u) THEN 5 * u
      WHEN 2 * u - c < 1.5 * (c - u) THEN 2 * u ELSE u END
    FROM (SELECT c, power(10.0, floor(log10(c))) AS u FROM (SELECT ({hi} - {lo}) / {n}.0 AS c)))"""


def breaks(src: str, value: str, n: int = 30) -> str:
    return f"""
SELECT CAST(bin AS INTEGER) AS bin, round(CASE WHEN w > 0 THEN (f + bin) * w ELSE lo END, {R}) AS bin_lo,
       round(CASE WHEN w > 0 THEN (f + bin + 1) * w ELSE lo END, {R}) AS bin_hi, count(*) AS n
FROM (SELECT w, f, lo, CASE WHEN w > 0 THEN greatest(ceil({value} / w - 1e-7) - f - 1, 0) ELSE 0 END AS bin
      FROM {src} CROSS JOIN (SELECT w, lo, CASE WHEN w > 0 THEN floor(lo / w + 1e-7) END AS f
                             FROM (SELECT lo, {width('lo', 'hi', n)} AS w FROM (SELECT min({value}) AS lo, max({value}) AS hi FROM {src}))))
GROUP BY bin, f, w, lo"""


CALIBRATION = f"""
cal AS (
  SELECT account_id, events_before, exposure_before, estimate, events_after, exposure_after, actual, estimate - actual AS error,
         CASE WHEN pop_var > 0 THEN {cdf('a', 'x')} WHEN actual >= pop_mean THEN 1.0 ELSE 0.0 END AS rank
  FROM (SELECT account_id, e.events AS events_before, e.exposure_days AS exposure_before, e.shrunk_rate AS estimate,
               p.events AS events_after, p.exposure_days AS exposure_after, p.events / p.exposure_days AS actual, pop_mean, pop_var,
               pop_mean * pop_mean / pop_var + e.events AS a, (pop_mean / pop_var + e.exposure_days) * (p.events / p.exposure_days) AS x
        FROM est_b e JOIN per_a p USING (account_id) CROSS JOIN est_b_mom WHERE p.exposure_days > 0)
)"""


def days_bins(grid: str) -> str:
    """Bins of a one-row grid (w, f, l), open at both ends."""
    return f"""(SELECT CAST(k - f AS INTEGER) AS bin, CASE WHEN k >= f THEN k * w END AS days_lo, CASE WHEN k < l THEN (k + 1) * w END AS days_hi
      FROM (SELECT w, f, l, unnest(range(CAST(f AS BIGINT) - 1, CAST(l AS BIGINT) + 1)) AS k FROM ({grid})))"""


def grid(ends: str, n: int = 30) -> str:
    return f"SELECT w, floor(lo / w + 1e-7) AS f, ceil(hi / w - 1e-7) AS l FROM (SELECT lo, hi, {width('lo', 'hi', n)} AS w FROM ({ends}))"


def mass(a: str, b: str) -> str:
    upto = lambda t: f"(1 - {cdf(a, f'({b} / {t})')})"
    return f"""greatest(CASE WHEN days_hi IS NULL THEN 1.0 ELSE {upto('days_hi')} END
          - CASE WHEN days_lo IS NULL OR days_lo <= 0 THEN 0.0 ELSE {upto('days_lo')} END, 0.0)"""


_ENDS = ", ".join(f"round(max(x / b) FILTER (p = {p}), {R}) AS {n}" for n, p in TAILS)
_ACCOUNT_ENDS = ", ".join(f"round(coalesce(max(x / (pop_b + exposure_days)) FILTER (p = {p}), any_value(pop_mean)), {R}) AS {n}" for n, p in TAILS)
_PS = ", ".join(str(p) for _, p in TAILS)

_POPULATION_ENDS = """
SELECT coalesce(max(pop_b / x) FILTER (p > 0.5), 0.5 / any_value(pop_mean)) AS lo,
       coalesce(max(pop_b / x) FILTER (p < 0.5), 1.5 / any_value(pop_mean)) AS hi
FROM (SELECT any_value(pop_b) AS pop_b, any_value(pop_mean) AS pop_mean FROM gam) LEFT JOIN qs ON true"""

ORACLE = {
    "rate_interval": _q(f"""
SELECT missed_flight_flag, round(any_value(post.a / b), {R}) AS rate_mean, {_ENDS}
FROM post JOIN qs ON key = missed_flight_flag GROUP BY missed_flight_flag""", POST,
                        quantiles(f"SELECT missed_flight_flag AS key, a, unnest([{_PS}]) AS p FROM post")),
    "account_rate_interval": _q(f"""
SELECT account_id, any_value(events) AS events, round(any_value(exposure_days), {R}) AS exposure_days,
       round(any_value(shrunk_rate), {R}) AS shrunk_rate, {_ACCOUNT_ENDS}
FROM gam LEFT JOIN qs ON key = account_id GROUP BY account_id""", PER, SHRINK, GAMMAS,
                                quantiles(f"SELECT account_id AS key, pop_a + events AS a, unnest([{_PS}]) AS p FROM gam WHERE pop_a IS NOT NULL")),
    "account_calibration": _q(f"""
SELECT account_id, events_before, round(exposure_before, {R}) AS exposure_before, round(estimate, {R}) AS estimate, events_after,
       round(exposure_after, {R}) AS exposure_after, round(actual, {R}) AS actual, round(error, {R}) AS error, round(rank, {R}) AS rank
FROM cal""", *BEFORE_AFTER, CALIBRATION),
    "account_calibration_histogram": _q(breaks("cal", "rank"), *BEFORE_AFTER, CALIBRATION),
    "shrunk_rate_breaks": _q(breaks("shr", "shrunk_rate"), PER, SHRINK),
    "implied_days_histogram": _q(f"""
SELECT missed_flight_flag, bin, round(days_lo, {R}) AS days_lo, round(days_hi, {R}) AS days_hi, round({mass('a', 'b')}, {R}) AS mass
FROM post CROSS JOIN {days_bins(grid('SELECT min(b / x) FILTER (p > 0.5) AS lo, max(b / x) FILTER (p < 0.5) AS hi FROM qs JOIN post ON key = missed_flight_flag'))}""",
                                 POST, quantiles("SELECT missed_flight_flag AS key, a, unnest([0.001, 0.999]) AS p FROM post")),
    "account_implied_days_histogram": _q(f"""
SELECT has_missed, bin, round(days_lo, {R}) AS days_lo, round(days_hi, {R}) AS days_hi, count(*) AS n_accounts, round(avg(m), {R}) AS mass
FROM (SELECT CASE WHEN n_missed > 0 THEN 1 ELSE 0 END AS has_missed, bin, days_lo, days_hi,
             CASE WHEN pop_a IS NULL
                  THEN CASE WHEN coalesce(days_lo, -1e300) < 1 / pop_mean AND 1 / pop_mean <= coalesce(days_hi, 1e300) THEN 1.0 ELSE 0.0 END
                  ELSE {mass('(pop_a + events)', '(pop_b + exposure_days)')} END AS m
      FROM gam CROSS JOIN {days_bins(grid(_POPULATION_ENDS))})
GROUP BY has_missed, bin, days_lo, days_hi""", PER, SHRINK, GAMMAS,
                                         quantiles("SELECT 0 AS key, max(pop_a) AS a, unnest([0.05, 0.95]) AS p FROM gam WHERE pop_a IS NOT NULL")),
}
