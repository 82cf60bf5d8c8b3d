"""Exact order statistics by distributed radix selection (no sort of the data).

Values are mapped to 64-bit integers in their order.  Four rounds find all
wanted ranks of all groups at once: a round counts the values under each
known prefix by their next 16 bits (a partial aggregate; at most 65,536 rows
a prefix are shuffled), and the running counts tell which 16 bits each rank
has.  After the last round a prefix is a single value.  Only prefixes that
hold a wanted rank are read on, so each round after the first aggregates a
small part of the rows.

The keyed values are written once to the shared folder, so that all rounds
see the same values even where they come from floating sums; the small table
of wanted ranks is written after each round.  NULLs take no part; -0.0 is
0.0; NaN comes after infinity, as in Spark's order.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
ROUNDS = 64 // BITS


def order_key(value: Column) -> Column:
    """A double as a 64-bit integer of the same order (sign, exponent, fraction)."""
    x = value.cast("double") + F.lit(0.0)
    size = F.abs(x)
    e = F.greatest(F.least(F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size).otherwise(1.0))), F.lit(1023)), F.lit(-1022))
    e = e.cast("double")
    # log2 may round across a power of two
    m = size / F.pow(F.lit(2.0), e)
    e = F.when((m >= 2) & (e < 1023), e + 1).when((m < 1) & (e > -1022), e - 1).otherwise(e)
    m = size / F.pow(F.lit(2.0), e)
    unit = F.lit(1 << 52)
    fraction = (F.when(m >= 1, m - 1).otherwise(m) * float(1 << 52)).cast("long")
    bits = F.when(m >= 1, (e + 1023).cast("long")).otherwise(0) * unit + fraction
    bits = F.when(F.isnan(x), (F.lit(2047) * unit) + (1 << 51)).when(size == float("inf"), F.lit(2047) * unit).otherwise(bits)
    return F.when(x < 0, -bits).otherwise(bits)


def _staged(df: DataFrame) -> DataFrame:
    from layover.session import checkpoint_dir, register_scratch

    path = register_scratch(df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/ranks-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _join(a: DataFrame, b: DataFrame, on: Sequence[str], take: Sequence[str], how: str = "inner") -> DataFrame:
    """``a`` with columns ``take`` of ``b``, on NULL-safe equality."""
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
    j = a.alias("_a").join(b.alias("_b"), cond, how)
    return j if how == "left_semi" else j.select("_a.*", *[F.col(f"_b.{c}").alias(c) for c in take])


def select_ranks(df: DataFrame, value: str, wanted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``wanted(keys..., rank)`` (1-based, distinct, within the group's size)
    with the value ``_value`` of that rank among the non-NULL values."""
    keys = list(keys)
    keyed = df.select(*keys, F.col(value).alias("_v"), order_key(F.col(value)).alias("_k"))
    state = wanted.select(*keys, "rank", F.col("rank").alias("_rest"), F.lit(0).cast("long").alias("_p"))
    for r in range(ROUNDS):
        shift = 64 - BITS * (r + 1)
        parent = F.shiftright("_k", shift + BITS) if r else F.lit(0).cast("long")
        x = keyed.withColumn("_p", parent)
        if r:
            x = _join(x, state.select(*keys, "_p").distinct(), [*keys, "_p"], [], "left_semi")
        counts = x.groupBy(*keys, "_p", F.shiftright("_k", shift).alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_value"))
        upto = F.sum("_n").over(Window.partitionBy(*keys, "_p").orderBy("_d"))
        counts = counts.withColumn("_upto", upto)
        hit = _join(state.select(*keys, "rank", "_rest", "_p"), counts, [*keys, "_p"], ["_d", "_n", "_upto", "_value"])
        hit = hit.where((F.col("_rest") <= F.col("_upto")) & (F.col("_rest") > F.col("_upto") - F.col("_n")))
        state = _staged(hit.select(*keys, "rank", (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_rest"),
                                   F.col("_d").alias("_p"), "_value"))
    return state.select(*keys, "rank", "_value")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles (R type 7, DuckDB ``quantile_cont``) from
    the two order statistics around each probability."""
    keys = [group] if group else []
    x = _staged(df.where(F.col(value).isNotNull()).select(*keys, value))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    sizes = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where("_size > 0")
    at = sizes.select(*keys, "_size", asked.alias("_a")).select(*keys, "_a.q", "_a.p", ((F.col("_size") - 1) * F.col("_a.p") + 1).alias("_h"))
    at = _staged(at.select("*", F.floor("_h").cast("long").alias("_lo"), F.ceil("_h").cast("long").alias("_hi")))
    wanted = at.select(*keys, F.explode(F.array("_lo", "_hi")).alias("rank")).distinct()
    found = select_ranks(x, value, wanted, keys)
    lo, hi = (found.select(*keys, F.col("rank").alias(f"_{n}"), F.col("_value").alias(f"_v{n}")) for n in ("lo", "hi"))
    y = _join(_join(at, lo, [*keys, "_lo"], ["_vlo"]), hi, [*keys, "_hi"], ["_vhi"])
    return y.select(*keys, "q", "p", (F.col("_vlo") + (F.col("_h") - F.col("_lo")) * (F.col("_vhi") - F.col("_vlo"))).alias("quantile"))
