"""Oracle SQL for the survival and rate-estimation jobs (closed forms)."""

from layover.oracle.prefix import with_prefix
from layover.oracle.retention import CENSORED_CTES, PAIRS_CTES, TRIPS_CTES

BASE = (TRIPS_CTES, PAIRS_CTES, CENSORED_CTES)
R = 9  # rounding digits of values built from floating sums


def _q(body: str, *extra: str) -> str:
    return with_prefix(body, ",\n".join(c.strip() for c in (*BASE, *extra)))


POST = f"""
post AS (
  SELECT missed_flight_flag, n_events, n_censored, exposure_days,
         CAST(0.8 AS DOUBLE) + n_events AS a, 0.33 + exposure_days AS b
  FROM (SELECT flags.missed_flight_flag,
               count(*) FILTER (censored_id = 0) AS n_events,
               count(*) FILTER (censored_id = 1) AS n_censored,
               coalesce(sum(days), 0.0) AS exposure_days
        FROM (VALUES (0), (1)) flags(missed_flight_flag)
        LEFT JOIN surv ON surv.missed_flight_flag = flags.missed_flight_flag GROUP BY flags.missed_flight_flag)
)"""

POST_COLS = f"""n_events, n_censored, round(exposure_days, {R}) AS exposure_days, a AS post_shape,
       round(b, {R}) AS post_rate, round(a / b, {R}) AS rate_mean, round(sqrt(a) / b, {R}) AS rate_sd,
       round(CASE WHEN a > 1 THEN b / (a - 1) END, {R}) AS mean_days_to_next"""

PER = """
per AS (
  SELECT account_id, count(*) AS n_rows, CAST(sum(missed_flight_flag) AS BIGINT) AS n_missed,
         CAST(sum(CASE WHEN censored_id = 0 THEN 1 ELSE 0 END) AS BIGINT) AS events, sum(days) AS exposure_days
  FROM surv GROUP BY account_id
)"""

SHRINK = """
mom AS (
  SELECT any_value(m) AS pop_mean, sum((events - m * exposure_days) ** 2 - events) / sum(exposure_days ** 2) AS pop_var
  FROM (SELECT *, sum(events) OVER () / sum(exposure_days) OVER () AS m FROM per)
),
shr AS (
  SELECT per.*, CASE WHEN pop_var > 0
                     THEN (pop_mean * pop_mean / pop_var + events) / (pop_mean / pop_var + exposure_days)
                     ELSE pop_mean END AS shrunk_rate
  FROM per CROSS JOIN mom
)"""

def per_from(src: str, name: str) -> str:
    return PER.strip().replace("per AS", f"{name} AS", 1).replace("FROM surv GROUP", f"FROM {src} GROUP")


def shrink_from(per: str, name: str) -> str:
    return (SHRINK.strip().replace("mom AS", f"{name}_mom AS", 1).replace("shr AS", f"{name} AS", 1)
            .replace("FROM per)", f"FROM {per})").replace("FROM per CROSS JOIN mom", f"FROM {per} CROSS JOIN {name}_mom")
            .replace("SELECT per.*", f"SELECT {per}.*"))


BEFORE_AFTER = ("""
bef AS (
  SELECT account_id, missed_flight_flag, CASE WHEN days > known THEN 1 ELSE censored_id END AS censored_id,
         least(days, known) AS days
  FROM (SELECT *, date_diff('microsecond', actual_arrival, TIMESTAMP '1998-07-01 00:00:00') / 1e6 / 86400.0 AS known
        FROM surv_ev WHERE actual_arrival < TIMESTAMP '1998-07-01 00:00:00')
)""", "aft AS (SELECT * FROM surv_ev WHERE actual_arrival >= TIMESTAMP '1998-07-01 00:00:00')",
                per_from("bef", "per_b"), per_from("aft", "per_a"), shrink_from("per_b", "est_b"))

ORACLE = {
    "mean_days_to_next": _q(f"SELECT count(*) AS n_rows, round(avg(days), {R}) AS mean_days FROM surv"),
    "rate_posterior": _q(f"""
SELECT {POST_COLS}
FROM (SELECT sum(n_events) AS n_events_, sum(n_censored) AS n_censored_, sum(exposure_days) AS e_ FROM post) x,
     LATERAL (SELECT CAST(n_events_ AS BIGINT) AS n_events, CAST(n_censored_ AS BIGINT) AS n_censored,
                     e_ AS exposure_days, CAST(0.8 AS DOUBLE) + n_events_ AS a, 0.33 + e_ AS b)""", POST),
    "rate_posterior_by_missed": _q(f"SELECT missed_flight_flag, {POST_COLS} FROM post", POST),
    "mean_time_to_next": _q(f"""
SELECT missed_flight_flag, round(CASE WHEN a > 1 THEN b / (a - 1) END, {R}) AS mean_days_to_next FROM post""",
                            POST),
    "survival_at_horizon": _q(f"""
SELECT missed_flight_flag, h AS horizon_days, round(exp(-(round(a / b, {R})) * h), {R}) AS survival_at_mean_rate,
       round(power(b / (b + h), a), {R}) AS survival_predictive
FROM post CROSS JOIN (SELECT unnest([1.0, 7.0, 30.0, 90.0, 365.0]::DOUBLE[]) AS h)""", POST),
    "time_quantile": _q(f"""
SELECT missed_flight_flag, u AS share_booked, round(-ln(1.0 - u) / round(a / b, {R}), {R}) AS days_at_mean_rate,
       round(b * (power(1.0 - u, -1.0 / a) - 1), {R}) AS days_predictive
FROM post CROSS JOIN (SELECT unnest([0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS u)""", POST),
    "account_flights_by_missed": _q(f"""
SELECT CASE n_missed WHEN 0 THEN 'none_missed' WHEN 1 THEN 'one_missed' ELSE 'more_missed' END AS accounts,
       count(*) AS n_accounts, round(avg(n_rows), {R}) AS mean_flights
FROM per GROUP BY 1""", PER),
    "missed_accounts": _q("""
SELECT * FROM surv WHERE account_id IN (SELECT account_id FROM surv WHERE missed_flight_flag = 1)"""),
    "account_index": _q("""
SELECT account_id, row_number() OVER (ORDER BY account_id) AS account_index
FROM (SELECT DISTINCT account_id FROM surv)"""),
    "account_sample": _q("""
SELECT * FROM surv WHERE account_id IN (
  SELECT account_id FROM (
    SELECT account_id, n_missed,
           row_number() OVER (ORDER BY md5(CAST(account_id AS VARCHAR) || ':24'), account_id) AS rk,
           CAST(round(count(*) OVER () * 0.01) AS BIGINT) AS k
    FROM per)
  WHERE n_missed >= 1 OR rk <= k)""", PER),
    "stratum_sufficient_stats": _q(f"""
SELECT censored_id, missed_flight_flag, count(*) AS n_rows, round(sum(days), {R}) AS exposure_days
FROM surv GROUP BY 1, 2"""),
    "account_rate_shrinkage": _q(f"""
SELECT account_id, events, round(exposure_days, {R}) AS exposure_days,
       round(CASE WHEN exposure_days = 0 THEN NULL ELSE events / exposure_days END, {R}) AS raw_rate,
       round(shrunk_rate, {R}) AS shrunk_rate
FROM shr""", PER, SHRINK),
    "stratified_rate_ratio": _q(f"""
SELECT CAST(sum(CASE WHEN t0 > 0 AND t1 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_accounts_both,
       round(CASE WHEN sum(den) = 0 THEN NULL ELSE sum(num) / sum(den) END, {R}) AS rate_ratio
FROM (SELECT t0, t1, CASE WHEN t0 + t1 > 0 THEN d1 * t0 / (t0 + t1) ELSE 0.0 END AS num,
             CASE WHEN t0 + t1 > 0 THEN d0 * t1 / (t0 + t1) ELSE 0.0 END AS den
      FROM (SELECT account_id,
                   CAST(sum(CASE WHEN missed_flight_flag = 0 AND censored_id = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS d0,
                   sum(CASE WHEN missed_flight_flag = 0 THEN days ELSE 0.0 END) AS t0,
                   CAST(sum(CASE WHEN missed_flight_flag = 1 AND censored_id = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS d1,
                   sum(CASE WHEN missed_flight_flag = 1 THEN days ELSE 0.0 END) AS t1
            FROM surv GROUP BY account_id))"""),
    "rate_ratio_interval": _q(f"""
SELECT coalesce(any_value(na), 0) AS n_accounts, any_value(rr) AS rate_ratio, count(ratio) AS replicates, round(stddev_samp(ratio), {R}) AS std_error,
       round(quantile_cont(ratio, 0.1), {R}) AS lower_80, round(quantile_cont(ratio, 0.9), {R}) AS upper_80,
       round(quantile_cont(ratio, 0.025), {R}) AS lower_95, round(quantile_cont(ratio, 0.975), {R}) AS upper_95
FROM (SELECT b, CASE WHEN sum(w * den) > 0 THEN sum(w * num) / sum(w * den) END AS ratio
      FROM (SELECT *, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
                                       0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020, 0.9999998885745217],
                                      lambda c: ('0x' || substr(md5(account_id::VARCHAR || ':' || b || ':b'), 1, 13))::BIGINT / 4503599627370496.0 >= c)) AS w
            FROM terms CROSS JOIN (SELECT unnest(range(1, 201)) AS b)) GROUP BY b)
CROSS JOIN (SELECT count(*) AS na, round(CASE WHEN sum(den) > 0 THEN sum(num) / sum(den) END, {R}) AS rr FROM terms)""", """
terms AS (
  SELECT * FROM (
    SELECT account_id, coalesce(d1 * t0 / nullif(t0 + t1, 0), 0) AS num, coalesce(d0 * t1 / nullif(t0 + t1, 0), 0) AS den
    FROM (SELECT account_id, CAST(count(*) FILTER (missed_flight_flag = 0 AND censored_id = 0) AS DOUBLE) AS d0,
                 coalesce(sum(days) FILTER (missed_flight_flag = 0), 0) AS t0,
                 CAST(count(*) FILTER (missed_flight_flag = 1 AND censored_id = 0) AS DOUBLE) AS d1,
                 coalesce(sum(days) FILTER (missed_flight_flag = 1), 0) AS t1 FROM surv GROUP BY account_id))
  WHERE num > 0 OR den > 0
)"""),
    "rate_deciles": _q(f"""
SELECT CAST(i - 1 AS INTEGER) AS q, ps[i] AS p, round(qs[i], {R}) AS quantile
FROM (SELECT quantile_cont(shrunk_rate, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS qs,
             [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[] AS ps FROM shr)
CROSS JOIN (SELECT unnest(range(1, 10)) AS i)""", PER, SHRINK),
    "calibration_summary": _q(f"""
SELECT count(*) AS n_accounts, round(avg(estimate - actual), {R}) AS mean_error,
       round(avg(abs(estimate - actual)) / avg(abs(actual)), {R}) AS relative_abs_error,
       round(avg(CASE WHEN estimate <= actual THEN 1.0 ELSE 0.0 END), {R}) AS share_estimate_below
FROM (SELECT account_id, shrunk_rate AS estimate FROM est_b)
JOIN (SELECT account_id, events / exposure_days AS actual FROM per_a WHERE exposure_days > 0) USING (account_id)""",
                              *BEFORE_AFTER),
    "posterior_histogram": _q(f"""
SELECT has_missed, CAST(bin AS INTEGER) AS bin, round(lo + bin * w, {R}) AS bin_lo,
       round(lo + (bin + 1) * w, {R}) AS bin_hi, count(*) AS n
FROM (SELECT CASE WHEN n_missed > 0 THEN 1 ELSE 0 END AS has_missed, lo, w,
             CASE WHEN w = 0 THEN 0 ELSE least(floor((shrunk_rate - lo) / w), 29) END AS bin
      FROM shr CROSS JOIN (SELECT min(shrunk_rate) AS lo, (max(shrunk_rate) - min(shrunk_rate)) / 30.0 AS w FROM shr))
GROUP BY has_missed, bin, lo, w""", PER, SHRINK),
}
