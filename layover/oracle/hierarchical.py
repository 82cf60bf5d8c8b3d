"""Oracle SQL of the hierarchical model.

The fit is a recursive CTE: each step integrates every account over fifteen
Gauss-Hermite nodes around its mode, sums gradient and Hessian, and solves
the three Newton equations by Cramer's rule.  The accounts' own rates are
then integrated over narrower panels than the job's, and quantiles found by halving.
"""

import math

import numpy as np

from layover.oracle.survival import R, _q

STEPS = 25
PANELS = 60

STATS = """
hst AS (
  SELECT * FROM (
    SELECT account_id, CAST(count(*) FILTER (missed_flight_flag = 0 AND censored_id = 0) AS DOUBLE) AS d0,
           coalesce(sum(days) FILTER (missed_flight_flag = 0), 0.0) AS t0,
           CAST(count(*) FILTER (missed_flight_flag = 1 AND censored_id = 0) AS DOUBLE) AS d1,
           coalesce(sum(days) FILTER (missed_flight_flag = 1), 0.0) AS t1
    FROM surv GROUP BY account_id)
  WHERE t0 + t1 > 0
),
prior AS (
  SELECT count(*) AS n, CASE WHEN sum(d0 + d1) > 0 THEN ln(sum(d0 + d1) / sum(t0 + t1)) ELSE -2.1 END AS centre,
         sum(d0) AS d0, sum(t0) AS t0, sum(d1) AS d1, sum(t1) AS t1, sum(t0 + t1) AS t, sum(d0 + d1) AS d,
         sum((d0 + d1) * (d0 + d1)) AS dd, sum((d0 + d1) * (t0 + t1)) AS dt, sum((t0 + t1) * (t0 + t1)) AS tt
  FROM hst
)"""

_X, _W = np.polynomial.hermite.hermgauss(15)
_NODES = ", ".join(f"({float(math.log(w / math.sqrt(math.pi)) + x * x)!r}::DOUBLE, {float(math.sqrt(2) * x)!r}::DOUBLE)" for x, w in zip(_X, _W))


def _mode(src: str, steps: int = 8) -> str:
    """``src`` (d, e, t and more) with the mode ``mu`` and scale ``s`` of each account's effect."""
    q = f"SELECT *, ln(greatest(d, 0.5) / e) * t * greatest(d, 0.5) / (1 + t * t * greatest(d, 0.5)) AS mu FROM ({src})"
    for _ in range(steps):
        q = f"SELECT * REPLACE (mu - (mu - t * d + t * e * exp(t * mu)) / (1 + t * t * e * exp(t * mu)) AS mu) FROM ({q})"
    return f"SELECT *, 1 / sqrt(1 + t * t * e * exp(t * mu)) AS s FROM ({q})"


_SUMS = {"gb": "d0 - e0", "gm": "d1 - e1", "gt": "h * (d0 + d1 - e0 - e1)", "hbb": "-e0", "hmm": "-e1", "htt": "-h * h * (e0 + e1)",
         "hbt": "-h * e0", "hmt": "-h * e1", "gbgb": "(d0 - e0) ** 2", "gmgm": "(d1 - e1) ** 2", "gtgt": "(h * (d0 + d1 - e0 - e1)) ** 2",
         "gbgm": "(d0 - e0) * (d1 - e1)", "gbgt": "h * (d0 - e0) * (d0 + d1 - e0 - e1)", "gmgt": "h * (d1 - e1) * (d0 + d1 - e0 - e1)"}

FIT = f"""
gh(lw, z) AS (VALUES {_NODES}),
steps(k, b, m, t, vb, vm, vt, gb, gm, gt) AS (
  SELECT 0, CASE WHEN d0 > 0 AND t0 > 0 THEN ln(d0 / t0) ELSE centre END, CASE WHEN d1 > 0 AND t1 > 0 THEN ln(d1 / t1) ELSE centre END,
         CASE WHEN d > 0 THEN greatest(sqrt(ln(1 + greatest((dd - 2 * (d / t) * dt + (d / t) * (d / t) * tt - d) / tt, 0.0) / ((d / t) * (d / t)))), 0.001)
              ELSE 0.4 END, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  FROM prior
  UNION ALL
  SELECT k + 1, b + f * sb, m + f * sm, greatest(t + f * st, 0.001), cbb / det, cmm / det, ctt / det, gb, gm, gt
  FROM (
    SELECT *, 0.3 / greatest(0.3, abs(sb), abs(sm), abs(st)) AS f
    FROM (
      SELECT *, (cbb * gb + cbm * gm + cbt * gt) / det AS sb, (cbm * gb + cmm * gm + cmt * gt) / det AS sm, (cbt * gb + cmt * gm + ctt * gt) / det AS st
      FROM (
        SELECT *, amm * att - amt * amt AS cbb, amt * abt - abm * att AS cbm, abm * amt - amm * abt AS cbt,
               abb * att - abt * abt AS cmm, abm * abt - abb * amt AS cmt, abb * amm - abm * abm AS ctt,
               abb * (amm * att - amt * amt) - abm * (abm * att - amt * abt) + abt * (abm * amt - amm * abt) AS det
        FROM (
          SELECT k, b, m, t, sum(gb) - (b - any_value(centre)) / 0.01 AS gb, sum(gm) - (m - any_value(centre)) / 0.01 AS gm,
                 sum(gt) - (t - 0.4) / 0.01 AS gt, -sum(hbb + gbgb - gb * gb) + 100 AS abb, -sum(hmm + gmgm - gm * gm) + 100 AS amm,
                 -sum(htt + gtgt - gt * gt) + 100 AS att, -sum(gbgm - gb * gm) AS abm, -sum(hbt + gbgt - gb * gt) AS abt, -sum(hmt + gmgt - gm * gt) AS amt
          FROM (
            SELECT k, b, m, t, account_id, any_value(centre) AS centre, {', '.join(f'sum(w * ({x})) / sum(w) AS {n}' for n, x in _SUMS.items())}
            FROM (
              SELECT *, exp(l - max(l) OVER (PARTITION BY account_id)) AS w
              FROM (
                SELECT *, lw + ln(s) - 0.5 * h * h + d0 * (b + t * h) + d1 * (m + t * h) - e0 - e1 AS l
                FROM (
                  SELECT *, t0 * exp(b + t * h) AS e0, t1 * exp(m + t * h) AS e1
                  FROM (SELECT *, mu + s * z AS h FROM ({_mode('''
                    SELECT k, b, m, steps.t, centre, account_id, hst.d0, hst.t0, hst.d1, hst.t1, hst.d0 + hst.d1 AS d, hst.t0 * exp(b) + hst.t1 * exp(m) AS e
                    FROM steps CROSS JOIN hst CROSS JOIN prior WHERE k < ''' + str(STEPS))}) CROSS JOIN gh))))
            GROUP BY k, b, m, t, account_id)
          GROUP BY k, b, m, t))))
),
fit AS (SELECT * FROM steps WHERE k = {STEPS})"""


def _density(x: str) -> str:
    return f"exp(-0.5 * ({x} * {x} - mu * mu) + t * d * ({x} - mu) - e * (exp(t * {x}) - exp(t * mu)))"


_GAUSS = [((1 + float(x)) / 2, float(w) / 2) for x, w in zip(*np.polynomial.legendre.leggauss(7))]


def _part(left: str, wide: str) -> str:
    """Mass between ``left`` and ``left + wide``."""
    return f"({wide}) * (" + " + ".join(f"{w!r}::DOUBLE * {_density(f'({left} + {x!r}::DOUBLE * ({wide}))')}" for x, w in _GAUSS) + ")"


def _panel_sum(factor: str) -> str:
    """Sum over all panels of ``factor`` (of {x}) times the density."""
    at = [(f"(a + (i + {x!r}::DOUBLE) * h)", w) for x, w in _GAUSS]
    inner = " + ".join(f"{w!r}::DOUBLE * {factor.format(x=x)} * {_density(x)}" for x, w in at)
    return f"list_sum(list_transform(range(0, {PANELS}), lambda i: h * ({inner})))"


RATES = f"""
modes AS MATERIALIZED (
  SELECT account_id, d0, d1, b, m, t, d, e, mu, a, (mu + 9 * s - a) / {PANELS} AS h
  FROM (SELECT *, mu - least(9.0, 40 * s) AS a
        FROM ({_mode('''SELECT account_id, hst.d0, hst.d1, b, m, t, hst.d0 + hst.d1 AS d, hst.t0 * exp(b) + hst.t1 * exp(m) AS e FROM hst CROSS JOIN fit''', 20)}))
),
masses AS MATERIALIZED (
  SELECT *, {_panel_sum('1')} AS n, {_panel_sum('exp(t * ({x} - mu))')} AS m1, {_panel_sum('exp(2 * t * ({x} - mu))')} AS m2 FROM modes
),
panels AS (
  SELECT account_id, i, mass, sum(mass) OVER (PARTITION BY account_id ORDER BY i) AS upto, a + i * h AS l
  FROM (SELECT *, {_part('(a + i * h)', 'h')} AS mass FROM masses CROSS JOIN (SELECT unnest(range(0, {PANELS})) AS i))
),
aimed AS MATERIALIZED (
  SELECT account_id, p, arg_min(l, i) AS l, min(i), arg_min(p * n - (upto - mass), i) AS r
  FROM panels JOIN masses USING (account_id) CROSS JOIN (VALUES (0.1), (0.5), (0.9)) v(p) WHERE upto >= p * n GROUP BY account_id, p
),
halved(account_id, p, l, r, lo, hi, k, d, e, t, mu) AS (
  SELECT account_id, p, l, r, 0.0::DOUBLE, h, 0, d, e, t, mu FROM aimed JOIN masses USING (account_id)
  UNION ALL
  SELECT account_id, p, l, r, CASE WHEN c < r THEN mid ELSE lo END, CASE WHEN c < r THEN hi ELSE mid END, k + 1, d, e, t, mu
  FROM (SELECT *, {_part('l', 'mid')} AS c FROM (SELECT *, (lo + hi) / 2 AS mid FROM halved WHERE k < 45))
),
etas AS (SELECT account_id, p, l + (lo + hi) / 2 AS eta FROM halved WHERE k = 45)"""


def _columns(name: str, b: str) -> str:
    level = f"exp({b} + t * mu)"
    quantiles = ", ".join(f"round(exp({b} + t * {q}), {R}) AS {name}_{q}" for q in ("p10", "p50", "p90"))
    return f"round({level} * (m1 / n), {R}) AS {name}_mean, round({level} * sqrt(greatest(m2 / n - (m1 / n) ** 2, 0)), {R}) AS {name}_sd, {quantiles}"


ORACLE = {
    "hierarchical_rate_fit": _q("""
SELECT p AS parameter, est AS estimate, sqrt(v) AS std_error, round(g, 4) + 0.0 AS gradient,
       CASE WHEN p <> 'tau' THEN exp(-est + 0.5 * v) END AS mean_days_to_next, true AS converged, n AS n_accounts
FROM (SELECT 'beta' AS p, b AS est, vb AS v, gb AS g FROM fit UNION ALL SELECT 'beta_missed', m, vm, gm FROM fit
      UNION ALL SELECT 'tau', fit.t, vt, gt FROM fit) CROSS JOIN prior""", STATS, FIT),
    "account_hierarchical_rates": _q(f"""
SELECT account_id, CAST(d0 AS BIGINT) AS events_made, CAST(d1 AS BIGINT) AS events_missed, {_columns('made', 'b')}, {_columns('missed', 'm')}
FROM masses JOIN (SELECT account_id, max(eta) FILTER (p = 0.1) AS p10, max(eta) FILTER (p = 0.5) AS p50, max(eta) FILTER (p = 0.9) AS p90
                  FROM etas GROUP BY account_id) USING (account_id)""", STATS, FIT, RATES),
}
