"""The airline adapter as a DuckDB CTE prefix.

Same rules as ``layover.sources.adapter`` (``FIXTURES.md``), written in
plain SQL over the driver's views.  Every oracle query is
``WITH <PREFIX>, <its own CTEs> SELECT …``; DuckDB inlines the CTEs it
uses and drops the others.
"""

PREFIX = """
booking AS (
  SELECT o_orderkey AS booking_id, o_custkey AS account_id, o_orderdate AS update_ts FROM orders
),
leg_base AS (
  SELECT l.l_orderkey, l.l_suppkey, o.o_orderdate,
         CAST(row_number() OVER (PARTITION BY l.l_orderkey
                                 ORDER BY l.l_linenumber, l.l_suppkey, l.l_partkey) AS INTEGER) AS leg_num
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
booking_leg AS (
  SELECT l_orderkey * 1000000 + leg_num AS booking_leg_id,
         l_orderkey AS booking_id,
         l_suppkey * 1000000 + (date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))
                              + 14 + l_orderkey % 60 + leg_num) AS flight_id,
         leg_num,
         leg_num % 2 = 0 AS is_returning,
         o_orderdate AS update_ts
  FROM leg_base
),
flight_h AS (
  SELECT flight_id, flight_id // 1000000 AS sk, flight_id % 1000000 AS d, (flight_id * 7919) % 1000 AS h
  FROM (SELECT DISTINCT flight_id FROM booking_leg)
),
flight_s AS (
  SELECT *,
         TIMESTAMP '1995-01-01 00:00:00' + to_minutes(CAST(d * 1440 + (sk * 37) % 1440 AS BIGINT)) AS scheduled_departure,
         CASE WHEN h BETWEEN 700 AND 899 THEN h - 700 ELSE 0 END AS delay
  FROM flight_h
),
flight_t AS (
  SELECT *, scheduled_departure + to_minutes(CAST(60 + (sk * 7) % 400 AS BIGINT)) AS scheduled_arrival,
         (h BETWEEN 940 AND 949) OR scheduled_departure >= TIMESTAMP '2001-05-01 00:00:00' AS no_actual
  FROM flight_s
),
flight AS (
  SELECT flight_id,
         CAST(sk * 10 + h % (1 + sk % 4) AS VARCHAR) AS flight_no,
         scheduled_departure,
         scheduled_arrival,
         'N' || lpad(CAST(sk % 25 AS VARCHAR), 2, '0') AS departure_airport,
         'N' || lpad(CAST((sk + 1 + (sk // 25) % 24) % 25 AS VARCHAR), 2, '0') AS arrival_airport,
         CASE WHEN h BETWEEN 940 AND 949 THEN 'Canceled' WHEN delay > 0 THEN 'Delayed' ELSE 'On schedule' END AS status,
         'AC' || CAST((sk + CASE WHEN h % 5 = 0 THEN 7 ELSE 0 END) % 12 AS VARCHAR) AS aircraft_code,
         CASE WHEN no_actual THEN NULL
              WHEN h BETWEEN 950 AND 979 THEN scheduled_arrival
              WHEN h >= 980 THEN scheduled_departure
              ELSE scheduled_departure + to_minutes(CAST(delay AS BIGINT)) END AS actual_departure,
         CASE WHEN no_actual THEN NULL
              WHEN h BETWEEN 950 AND 979 THEN scheduled_departure
              WHEN h >= 980 THEN scheduled_departure + INTERVAL 5 MINUTE
              ELSE scheduled_arrival + to_minutes(CAST(delay AS BIGINT)) END AS actual_arrival
  FROM flight_t
),
aircraft AS (
  SELECT 'AC' || CAST(p_partkey AS VARCHAR) AS code, p_name AS model,
         CAST(1000 + p_size * 100 AS INTEGER) AS "range", p_type AS "class"
  FROM part
),
airport AS (
  SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS airport_code, n_name AS city, r_name AS airport_tz
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
account AS (
  SELECT c_custkey AS account_id, 'Fn' || CAST(c_custkey % 50 AS VARCHAR) AS first_name,
         'Ln' || CAST(c_custkey AS VARCHAR) AS last_name,
         CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS frequent_flyer_id
  FROM customer
),
frequent_flyer AS (
  SELECT c_custkey AS frequent_flyer_id, c_mktsegment AS level,
         CAST(floor(c_acctbal * 100) AS INTEGER) AS award_points
  FROM customer WHERE c_custkey % 3 = 0
),
passenger AS (
  SELECT o_orderkey * 10 + i AS passenger_id, o_orderkey AS booking_id,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS account_id,
         'Fn' || CAST((o_custkey + i * 17) % 50 AS VARCHAR) AS first_name,
         'Ln' || CAST(o_custkey AS VARCHAR) AS last_name,
         o_orderdate AS update_ts
  FROM (SELECT o.*, unnest(range(0, o_orderkey % 3 + 1)) AS i FROM orders o)
),
boarding_pass AS (
  SELECT bl.booking_leg_id * 10 + p.passenger_id % 10 AS pass_id, p.passenger_id, bl.booking_leg_id,
         f.actual_departure - INTERVAL 30 MINUTE AS boarding_time,
         f.actual_departure - INTERVAL 30 MINUTE AS update_ts
  FROM passenger p JOIN booking_leg bl ON p.booking_id = bl.booking_id
  JOIN flight f ON bl.flight_id = f.flight_id
  WHERE f.actual_departure IS NOT NULL
)"""


class OracleSQL(str):
    """SQL text ``WITH <prefix>, <extra> <body>`` that can also be rendered
    without the adapter prefix, for airline tables registered directly."""

    extra: str
    body: str

    def without_prefix(self) -> str:
        return (("WITH RECURSIVE " + self.extra + "\n") if self.extra else "") + self.body


def with_prefix(body: str, extra_ctes: str = "") -> OracleSQL:
    """``WITH <prefix>[, extra] <body>``."""
    extra = extra_ctes.strip().rstrip(",")
    ctes = PREFIX + ((",\n" + extra) if extra else "")
    q = OracleSQL("WITH RECURSIVE " + ctes.strip() + "\n" + body.strip())
    q.extra, q.body = extra, body.strip()
    return q
