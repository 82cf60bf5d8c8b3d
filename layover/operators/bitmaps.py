"""Exact distinct counts of integer ids by mergeable bitmaps.

Ids are cut into buckets of 32,768; a bucket is one bitmap of 4 KB, built on
the map side and merged by bitwise or.  A shuffle then moves bitmaps instead
of ids: for dense ids a bit each instead of eight bytes, whatever the number
of rows.  Ids so sparse that their bitmaps would be larger than themselves
are counted by an ordinary distinct aggregate instead; one aggregate over
the ids (extremes, estimated numbers of ids and buckets) decides.

Set differences are counted through unions: ``|A \\ B| = |A or B| - |B|``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = 32_768
BITMAP_BYTES, ID_BYTES = 4096, 8
#: ids further apart than this cannot be shifted to start at 1
WIDEST = 1 << 62


def _shape(ids: list[DataFrame]) -> tuple[int, bool]:
    """(least id, whether bitmaps are smaller than the ids) over all sides."""
    rows = [d.agg(F.min("id").cast("decimal(20,0)").alias("lo"), F.max("id").cast("decimal(20,0)").alias("hi"), F.approx_count_distinct("id").alias("n"),
                  F.approx_count_distinct(F.floor(F.col("id") / BUCKET)).alias("b")).first() for d in ids]
    rows = [r for r in rows if r["lo"] is not None]
    if not rows:
        return 0, True
    lo, hi = min(r["lo"] for r in rows), max(r["hi"] for r in rows)
    dense = all(r["b"] * BITMAP_BYTES <= r["n"] * ID_BYTES or r["b"] <= 64 for r in rows)
    return int(lo), dense and hi - lo < WIDEST


def _bitmaps(ids: DataFrame, lo: int) -> DataFrame:
    """(bucket, bits) of the ids, shifted to start at 1."""
    x = ids.where("id is not null").select((F.col("id") - F.lit(lo) + 1).alias("id"))
    return x.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def _size(bitmaps: DataFrame, name: str) -> DataFrame:
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias(name))


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row: number of distinct non-NULL ids in ``column``."""
    ids = df.select(F.col(column).cast("long").alias("id"))
    lo, dense = _shape([ids])
    return _size(_bitmaps(ids, lo), name) if dense else ids.agg(F.countDistinct("id").alias(name))


def set_counts(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: distinct ids of ``a``, of ``b``, of both, and of ``a`` alone."""
    sides = [d.select(F.col(column).cast("long").alias("id")) for d in (a, b)]
    lo, dense = _shape(sides)
    if dense:
        maps = [_bitmaps(s, lo).withColumn("side", F.lit(i)) for i, s in enumerate(sides)]
        either = maps[0].unionByName(maps[1])
        g = either.groupBy("bucket").agg(*[F.coalesce(F.max(F.when(F.col("side") == i, F.bitmap_count("bits"))), F.lit(0)).alias(n) for i, n in enumerate("ab")],
                                         F.bitmap_count(F.bitmap_or_agg("bits")).alias("u"))
        x = g.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in "abu"])
    else:
        marked = sides[0].withColumn("side", F.lit(1)).unionByName(sides[1].withColumn("side", F.lit(2))).where("id is not null")
        g = marked.groupBy("id").agg(F.bit_or("side").alias("in"))
        x = g.agg(F.count_if(F.col("in") != 2).alias("a"), F.count_if(F.col("in") != 1).alias("b"), F.count(F.lit(1)).alias("u"))
    return x.select(F.col("a").alias("n_a"), F.col("b").alias("n_b"), (F.col("a") + F.col("b") - F.col("u")).alias("n_both"),
                    (F.col("u") - F.col("b")).alias("n_a_only"))
