"""T2: whole-table extremes without an unpartitioned window.

``max(x) over ()`` or ``min(x) over (order by x)`` moves every row into a
single task.  The same value is one scalar aggregate (partial aggregation
on every partition, one tiny final merge); the one-row result is attached
with a broadcast cross join, whose size is fixed at one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_row(df: DataFrame, **aggs: Column) -> DataFrame:
    """A one-row DataFrame of named aggregates over ``df``."""
    return df.agg(*[c.alias(n) for n, c in aggs.items()])


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame to every row of ``df``."""
    return df.crossJoin(F.broadcast(one_row))


def with_bounds(df: DataFrame, source: DataFrame | None = None, **aggs: Column) -> DataFrame:
    """``df`` plus whole-table aggregates of ``source`` (default ``df``)."""
    return attach(df, scalar_row(df if source is None else source, **aggs))
