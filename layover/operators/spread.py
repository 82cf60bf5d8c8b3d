"""Even deals of rows that are few but dear.

After an aggregate adaptive execution joins small partitions until they hold
enough bytes.  Rows that each cost a numerical fit are then left to one or two
tasks; an explicit number of partitions is not adapted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by the unique ``key`` over the ranges of its size, never
    fewer than the session's shuffle partitions."""
    from layover.session import range_count

    return df.repartition(range_count(df), key)
