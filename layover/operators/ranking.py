"""T3/T4: global ranks and ``ntile`` without a global window (quantiles: see
``selection``).

``row_number() over (order by x)`` and ``ntile(n) over (order by x)`` with
no PARTITION BY run in one task.  Instead:

1. range-partition the rows on the ordering (``repartitionByRange``; Spark
   samples the bounds) and sort inside each partition;
2. number rows inside each partition (``monotonically_increasing_id``
   after the sort is the position inside the partition, offset by the
   partition id in its upper bits);
3. count rows per partition (one row per partition), turn the counts into
   offsets with a window over that tiny table, and broadcast the offsets
   (their size is the number of partitions).

The global index is ``offset[partition] + position``.  Ordering columns
must form a total order (add a unique tie-breaker), so the index is
deterministic and re-computed identically if a task is retried.

The range-sorted frame is read twice (counts, then positions), so it is
checkpointed once to the shared checkpoint folder: the upstream plan runs
a single time and the lineage of the result is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_index(df: DataFrame, order: Sequence[str], out: str = "idx",
                 partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """1-based position of each row in the total order ``order``."""
    order = list(order)
    from layover.session import range_count

    n = partitions or range_count(df)
    r = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    r = r.withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    if materialize:
        from layover.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(df.sparkSession)
        r = r.checkpoint(eager=True)
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (r.join(F.broadcast(offsets), "_pid", "inner")
            .withColumn(out, F.col("_off") + F.col("_pos") + 1)
            .drop("_pid", "_mid", "_pos", "_off"))


def with_count(df: DataFrame, out: str = "n_total") -> DataFrame:
    """Attach the total row count (one-row broadcast)."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(out))))


def ntile_of(idx: str, n_total: str, tiles: int) -> "F.Column":
    """SQL ``ntile(tiles)`` bucket of a 1-based index: the first ``N mod tiles``
    buckets hold one extra row."""
    i, n = F.col(idx) - 1, F.col(n_total)
    q = F.floor(n / tiles)
    r = n % tiles
    big = r * (q + 1)  # rows in the larger buckets
    return (F.when(i < big, F.floor(i / (q + 1)) + 1)
            .otherwise(r + F.floor((i - big) / F.greatest(q, F.lit(1))) + 1)).cast("int")


def ntile(df: DataFrame, order: Sequence[str], tiles: int, out: str = "nt") -> DataFrame:
    x = with_count(global_index(df, order, "_idx"), "_n")
    return x.withColumn(out, ntile_of("_idx", "_n", tiles)).drop("_idx", "_n")
