"""Timestamp arithmetic on ``timestamp_ntz`` columns.

Postgres turns ``a - b`` into an interval and ``extract(epoch from …)``
into seconds.  Spark has no ``extract(epoch …)`` for intervals, so the
difference is taken in microseconds with ``timestamp_diff`` (exact, no
time zone involved) and scaled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seconds_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """``extract(epoch from later - earlier)`` as a double; NULL if either is NULL."""
    return F.timestamp_diff("MICROSECOND", _c(earlier), _c(later)) / F.lit(1_000_000.0)


def minutes_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    return seconds_between(later, earlier) / F.lit(60.0)


def hours_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    return seconds_between(later, earlier) / F.lit(3600.0)


def days_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    return seconds_between(later, earlier) / F.lit(86400.0)


def add_minutes(ts: ColumnOrName, minutes: ColumnOrName | int) -> Column:
    m = F.lit(minutes) if isinstance(minutes, int) else _c(minutes)
    return F.timestamp_add("MINUTE", m, _c(ts))
