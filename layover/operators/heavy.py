"""Joins on keys of which a few may hold a large part of the rows.

A sketch of the frequent keys (one mergeable aggregate, no shuffle of rows)
estimates how many rows each heavy key has on the left side.  Rows of a heavy
key are dealt over as many salts as their number asks for, and the key's
rows on the right are repeated once a salt; all other keys have one salt.
The join is then an ordinary equi-join on (key, salt), which spreads a key
with a third of all rows over many tasks before any of them starts; adaptive
skew handling can only split what one shuffle partition holds.

The table of heavy keys is broadcast: it has at most ``HEAVY`` rows.  Without
any (and without rows that lack the key) there is nothing to salt: the join is
on the key alone, so that a side dealt by it before stays where it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: heavy keys at most, and items that the sketch tracks to find them
HEAVY, TRACKED = 64, 4096
#: a key is heavy from this share of a task's even part of the rows
SHARE = 0.25


def heavy_keys(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """(key, salts): the keys with more rows than a quarter of an even part,
    and the number of parts their rows fill."""
    top = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {HEAVY}, {TRACKED})").alias("top"))
    x = top.select("n", F.explode("top").alias("t"))
    part = F.greatest(F.col("n") * SHARE / tasks, F.lit(1.0))
    x = x.select(F.col("t.item").alias(key), F.ceil(F.col("t.count") / part).cast("int").alias("salts"))
    return x.where("salts > 1").withColumn("salts", F.least("salts", F.lit(4 * tasks)))


def heavy_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", tasks: int | None = None) -> DataFrame:
    """``left.join(right, key, how)`` for ``inner`` and ``left``.  (``left`` is
    read once more for its keys.)"""
    if how not in ("inner", "left"):
        raise ValueError("the right side is repeated, so the join must be inner or left")
    n = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from layover.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(left.sparkSession)
    heavy = heavy_keys(left, key, n).checkpoint(eager=True)
    if heavy.isEmpty() and (how == "inner" or left.where(F.col(key).isNull()).isEmpty()):
        return left.join(right, key, how)
    heavy = F.broadcast(heavy)
    a = left.join(heavy, key, "left")
    # an even deal that a task which runs again repeats
    # (rows without a key match nothing and are dealt over all tasks)
    salts = F.when(F.col(key).isNull(), F.lit(4 * n)).otherwise(F.coalesce("salts", F.lit(1)))
    a = a.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), salts).cast("int"))
    b = right.join(heavy, key, "left")
    b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    return a.drop("salts").join(b.drop("salts"), [key, "_salt"], how).drop("_salt")
