"""layover: retention and time-to-event analytics over airline bookings, on Spark.

Subpackages
-----------
sources    table scans, the airline adapter, CSV and table sinks
functions  column-expression helpers (time arithmetic, Postgres-style text)
operators  reusable skew-safe DataFrame operators (two-level windows,
           global ranks, as-of pairing, histograms, first-per-key)
plans      the named jobs, one function per job
streaming  (empty: the reference has no streaming work)
oracle     DuckDB SQL used as the independent correctness oracle
"""

__version__ = "0.1.0"
