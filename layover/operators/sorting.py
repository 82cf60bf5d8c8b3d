"""O1/O2: ``ORDER BY`` with Postgres NULL placement.

Postgres sorts NULLs last ascending and first descending; Spark does the
opposite by default, so every sort key states its NULL placement.  A
final ``orderBy`` is a range-partitioned sort (sampled bounds, no single
task), so ordering a large result stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pg_key(spec: str) -> Column:
    """``"col"`` or ``"col desc"`` -> a Column sort key with Postgres NULL order."""
    parts = spec.split()
    c = F.col(parts[0])
    desc = len(parts) > 1 and parts[1].lower() == "desc"
    return c.desc_nulls_first() if desc else c.asc_nulls_last()


def pg_sort(df: DataFrame, *specs: str) -> DataFrame:
    return df.orderBy(*[pg_key(s) for s in specs])
