"""Skew-safe ordered operations inside a key (parallel scans).

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key
to one task.  Accounts are heavily skewed (one account may hold a third
of all bookings, and one timestamp of one account may hold many copies),
so the ordered operations the jobs need -- running sums with peers, row
numbers, the previous event -- are computed as a parallel scan for keys of
more than ``MANY_ROWS`` rows.  All other keys take the plain window, which
deals their rows once; ``large_keys`` finds out which are which over hash
buckets of the keys, without dealing the rows.  The scan:

1. rows that are peers in the order (equal key and order value) are
   collapsed first by a partial aggregate where the operation allows it
   (running sums), so no group of copies reaches one task;
2. the rows are range-partitioned on ``(key, order)``: Spark samples the
   bounds, so a hot key is split over as many partitions as its size
   needs, and every partition holds a contiguous run of each key;
3. inside each (partition, key) an ordinary window computes the local
   result;
4. a small table with one row per (partition, key) -- at most one row per
   key plus one per partition boundary -- carries each key's prefix from
   the partitions before it (a window over that table sees, for a hot
   key, as many rows as the partitions it spans).

The range-partitioned frame is read twice (local scan and carry table), so
it is checkpointed once to the shared checkpoint folder: partition ids
stay consistent even if tasks are retried, and the lineage is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_P = "_pid"
#: a key of more rows than this is not windowed in one task
MANY_ROWS = 10_000
#: hash buckets counted before any key is; only keys of full ones are counted
BUCKETS = 1 << 16


def _cols(xs) -> list:
    return [xs] if isinstance(xs, (str, Column)) else list(xs)


def _join_summary(x: DataFrame, s: DataFrame, on: list[str], take: list[str]) -> DataFrame:
    """Attach columns ``take`` of ``s`` to rows of ``x`` on ``on`` (NULL-safe
    equality, so NULL keys keep their rows)."""
    cond = [F.col("_x." + k).eqNullSafe(F.col("_s." + k)) for k in on]
    y = x.alias("_x").join(s.alias("_s"), cond, "inner")
    return y.select("_x.*", *[F.col("_s." + c).alias(c) for c in take])


def _range_partitioned(df: DataFrame, keys: list[str], order: list[Column],
                       partitions: int | None = None) -> DataFrame:
    """Range-partition on (keys, order), tag rows with their partition id and
    checkpoint (reliable, shared folder)."""
    from layover.session import ensure_checkpoint_dir, range_count

    spark = df.sparkSession
    n = partitions or range_count(df)
    r = df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn(_P, F.spark_partition_id())
    ensure_checkpoint_dir(spark)
    return r.checkpoint(eager=True)


def large_keys(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """The keys of more than ``most`` rows of ``df`` (None without any).

    A key cannot be large unless its hash bucket is, so a map-side aggregate
    of at most ``BUCKETS`` rows a task tells most tables apart from skewed
    ones; where a bucket is full, its keys are counted."""
    x = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("_bucket"))
    full = x.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_bucket")
    if full.isEmpty():
        return None
    x = x.join(F.broadcast(full), "_bucket", "left_semi")  # at most BUCKETS numbers
    many = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys)
    from layover.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    many = many.checkpoint(eager=True)
    return None if many.isEmpty() else many


def split(df: DataFrame, keys: Sequence[str], many: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the other keys, and rows of the keys ``many`` (NULL-safe)."""
    m = many.select(*[F.col(k).alias("_many_" + k) for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_many_" + k))
    return df.join(m, same, "left_anti"), df.join(m, same, "left_semi")


def _either(df: DataFrame, keys: list[str], rows: DataFrame | None, window, scan) -> DataFrame:
    """``window`` of the rows of ordinary keys and ``scan`` of those of large
    ones, as counted over ``rows`` (a plainer frame with the keys of ``df``)."""
    many = large_keys(df if rows is None else rows, keys, MANY_ROWS)
    if many is None:
        return window(df)
    small, large = split(df, keys, many)
    return window(small).unionByName(scan(large))


def _order_cols(order: Sequence) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column | None = None,
                out: str = "running", total: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """``sum(value) over (partition by keys order by order)`` with the default
    RANGE frame (peers included; ``value`` None counts rows), and optionally
    the per-key total ``sum(value) over (partition by keys)``."""
    keys = _cols(keys)
    v = F.lit(1) if value is None else value
    whole = Window.partitionBy(*keys)

    def window(x: DataFrame) -> DataFrame:
        y = x.withColumn("_v", v).withColumn(out, F.sum("_v").over(whole.orderBy(F.col(order).asc_nulls_last())).cast("long"))
        return (y.withColumn(total, F.sum("_v").over(whole).cast("long")) if total else y).drop("_v")

    return _either(df, keys, rows, window, lambda x: _scanned_sum(x, keys, order, v, out, total))


def _scanned_sum(df: DataFrame, keys: list[str], order: str, v: Column, out: str, total: str | None) -> DataFrame:
    peers = df.withColumn("_v", v).groupBy(*keys, order).agg(F.sum("_v").alias("_s"))
    r = _range_partitioned(peers, keys, _order_cols([order]))
    loc = r.withColumn("_loc", F.sum("_s").over(
        Window.partitionBy(_P, *keys).orderBy(F.col(order).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    carry = r.groupBy(_P, *keys).agg(F.sum("_s").alias("_t"))
    wk = Window.partitionBy(*keys).orderBy(_P)
    carry = carry.select(
        _P, *keys,
        F.coalesce(F.sum("_t").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_t").over(Window.partitionBy(*keys)).alias("_total"))
    res = _join_summary(loc, carry, [_P, *keys], ["_before", "_total"])
    res = res.select(*keys, order, (F.col("_before") + F.col("_loc")).cast("long").alias(out),
                     F.col("_total").cast("long").alias("_total"))
    y = _join_summary(df, res, [*keys, order], [out, "_total"])
    if total:
        y = y.withColumnRenamed("_total", total)
    return y.drop("_total")


def running_count(df: DataFrame, keys: Sequence[str], order: str, out: str = "running_count",
                  total: str | None = None) -> DataFrame:
    """``count(*) over (partition by keys order by order)`` with peers."""
    return running_sum(df, keys, order, None, out, total)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "row_index",
              rows: DataFrame | None = None) -> DataFrame:
    """``row_number() over (partition by keys order by order)``, ascending with
    NULLs last; rows that ``order`` does not tell apart must be alike."""
    keys, ocols = _cols(keys), _order_cols(_cols(order))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*ocols))
    return _either(df, keys, rows, lambda x: x.withColumn(out, number), lambda x: _scanned_index(x, keys, ocols, out))


def _scanned_index(df: DataFrame, keys: list[str], ocols: list[Column], out: str) -> DataFrame:
    r = _range_partitioned(df, keys, ocols)
    loc = r.withColumn("_rn_in", F.row_number().over(Window.partitionBy(_P, *keys).orderBy(*ocols)))
    carry = r.groupBy(_P, *keys).agg(F.count(F.lit(1)).alias("_nb"))
    wk = Window.partitionBy(*keys).orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(_P, *keys, F.coalesce(F.sum("_nb").over(wk), F.lit(0)).alias("_before"))
    y = _join_summary(loc, carry, [_P, *keys], ["_before"])
    return y.withColumn(out, (F.col("_before") + F.col("_rn_in")).cast("int")).drop(_P, "_rn_in", "_before")


def previous_event(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   payload: Sequence[str] = (), out: str = "prev", rows: DataFrame | None = None) -> DataFrame:
    """``lag(struct(order..., payload...)) over (partition by keys order by order)``.

    ``order`` must be a total order inside a key (add a unique tie-breaker).
    The result column ``out`` is a struct with the ordering and payload
    fields of the preceding row (NULL for the first row of a key).
    """
    keys, order, payload = _cols(keys), _cols(order), _cols(payload)
    ev = F.struct(*[F.col(c) for c in order + payload])
    lag = F.lag(ev).over(Window.partitionBy(*keys).orderBy(*order))
    return _either(df, keys, rows, lambda x: x.withColumn(out, lag), lambda x: scanned_previous(x, keys, order, payload, out))


def scanned_previous(df: DataFrame, keys: list[str], order: list[str], payload: list[str], out: str = "prev") -> DataFrame:
    """``previous_event`` by the parallel scan alone."""
    ev = F.struct(*[F.col(c) for c in order + payload])
    r = _range_partitioned(df.withColumn("_ev", ev), keys, [F.col(c).asc() for c in order])
    loc = r.withColumn("_prev_in", F.lag("_ev").over(Window.partitionBy(_P, *keys).orderBy(*order)))
    # last event of each (partition, key): max of the struct is lexicographic in the ordering fields
    carry = r.groupBy(_P, *keys).agg(F.max("_ev").alias("_last"))
    carry = carry.select(_P, *keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy(_P)).alias("_prev_b"))
    y = _join_summary(loc, carry, [_P, *keys], ["_prev_b"])
    return y.withColumn(out, F.coalesce("_prev_in", "_prev_b")).drop(_P, "_ev", "_prev_in", "_prev_b")
