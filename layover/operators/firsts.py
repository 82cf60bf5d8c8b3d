"""First-per-key and argmax-with-ties as aggregates (skew-safe).

``DISTINCT ON (k) … ORDER BY k, o`` and ``row_number() … = 1`` become
``min(struct(o…, payload…))`` per key: a partial aggregate, so a hot key
is reduced on every map task before the shuffle.  The ordering fields
must come first in the struct and make a total order.

``max(x) over (partition by k)`` followed by ``WHERE x = max`` (ties kept)
becomes a per-key aggregate joined back on ``(k, x)``; only the winning
rows survive the join, and adaptive execution splits a skewed join side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  payload: Sequence[str] = (), last: bool = False) -> DataFrame:
    keys, order, payload = list(keys), list(order), list(payload)
    s = F.struct(*[F.col(c) for c in order + [p for p in payload if p not in order]])
    agg = F.max(s) if last else F.min(s)
    out = df.groupBy(*keys).agg(agg.alias("_first"))
    return out.select(*keys, *[F.col("_first")[c].alias(c) for c in order + [p for p in payload if p not in order]])


def argmax_ties(df: DataFrame, keys: Sequence[str], value: str, out_max: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``value`` equals the per-key maximum (ties kept)."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.max(value).alias(value))
    res = df.join(m, [*keys, value], "inner")  # equi-join on (keys, value): winners only
    return res.withColumn(out_max, F.col(value)) if out_max else res
