"""A18/A19: equal-width and exact-value histograms.

The reference draws histograms in R; here the binned table is built.
Bins are equal-width over ``[lo, hi]``; when bounds are not given they are
the data's min and max (a one-row scalar aggregate).  The last bin is
closed on the right.  With given bounds no row is lost: values below are in
bin -1 (without a lower edge), values above in bin ``bins`` (without an upper
one).  Empty bins are not emitted.

``nice_breaks`` chooses its own break points: about ``n`` bins whose width is
1, 2 or 5 times a power of ten and whose edges are multiples of the width.
Bins are closed on the right, the first one on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the break rule: how far a wider step is preferred (to 2 and
# 10, and to 5 times a power of ten), and the share of a width that counts as
# rounding at an edge.
WIDER, WIDER_TO_FIVE, ROUNDING = 1.5, 2.75, 1e-7


def equal_width(df: DataFrame, value: str, bins: int, lo: float | None = None,
                hi: float | None = None, group: str | None = None) -> DataFrame:
    x = df.where(F.col(value).isNotNull())
    if lo is None or hi is None:
        b = x.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
        if lo is not None:
            b = b.withColumn("_lo", F.lit(float(lo)))
        if hi is not None:
            b = b.withColumn("_hi", F.lit(float(hi)))
        x = x.crossJoin(F.broadcast(b))
    else:
        x = x.withColumn("_lo", F.lit(float(lo))).withColumn("_hi", F.lit(float(hi)))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    raw = F.floor(F.try_divide(F.col(value) - F.col("_lo"), w))
    inside = F.when(w == 0, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1)))
    binc = F.when(F.col(value) < F.col("_lo"), -1).when(F.col(value) > F.col("_hi"), bins).otherwise(inside).cast("int")
    x = x.withColumn("bin", binc).withColumn("_w", w)
    keys = [group] if group else []
    lower, upper = (F.col("_lo") + (F.col("bin") + k) * F.col("_w") for k in (0, 1))
    return x.groupBy(*keys, "bin").agg(
        F.first("_lo").alias("_lo"), F.first("_w").alias("_w"), F.count(F.lit(1)).alias("n")
    ).select(*keys, "bin", F.when(F.col("bin") >= 0, lower).alias("bin_lo"),
             F.when(F.col("bin") < bins, upper).alias("bin_hi"), "n")


def nice_width(lo: Column, hi: Column, n: int) -> Column:
    """1, 2 or 5 times a power of ten: the width of about ``n`` bins from
    ``lo`` to ``hi`` (0 if they are equal)."""
    cell = (hi - lo) / float(n)
    base = F.pow(F.lit(10.0), F.floor(F.log10(cell)))
    two = 2 * base - cell < WIDER * (cell - base)
    five = two & (5 * base - cell < WIDER_TO_FIVE * (cell - 2 * base))
    ten = five & (10 * base - cell < WIDER * (cell - 5 * base))
    return F.when(cell <= 0, 0.0).otherwise(base * F.when(ten, 10).when(five, 5).when(two, 2).otherwise(1))


def with_nice_grid(df: DataFrame, lo: Column, hi: Column, n: int) -> DataFrame:
    """``df`` plus the grid ``_w`` (width), ``_first`` and ``_last``: the edges
    are ``_first * _w`` to ``_last * _w``."""
    x = df.withColumn("_lo", lo.cast("double")).withColumn("_hi", hi.cast("double"))
    x = x.withColumn("_w", nice_width(F.col("_lo"), F.col("_hi"), n))
    first = F.floor(F.try_divide("_lo", "_w") + ROUNDING)
    last = F.ceil(F.try_divide("_hi", "_w") - ROUNDING)
    return x.withColumn("_first", F.when(F.col("_w") > 0, first).cast("long")).withColumn("_last", F.when(F.col("_w") > 0, last).cast("long"))


def nice_breaks(df: DataFrame, value: str, n: int, lo: float | None = None, hi: float | None = None,
                group: str | None = None) -> DataFrame:
    """Counts in the bins of the break rule over the data's range, or over
    ``lo`` to ``hi``: values beyond the outer edges are in bin -1 and in the
    bin after the last.  Equal values only are one bin of no width."""
    x = df.where(F.col(value).isNotNull())
    low = F.min(value) if lo is None else F.lit(float(lo))
    high = F.max(value) if hi is None else F.lit(float(hi))
    bounds = x.agg(low.cast("double").alias("_l"), high.cast("double").alias("_h"))
    grid = with_nice_grid(bounds, F.col("_l"), F.col("_h"), n).drop("_l", "_h")
    x = x.crossJoin(F.broadcast(grid))
    at = F.ceil(F.try_divide(F.col(value), F.col("_w")) - ROUNDING) - F.col("_first") - 1
    bins = F.col("_last") - F.col("_first")
    lowest = F.col(value) >= F.col("_first") * F.col("_w") * (1 - F.signum("_first") * ROUNDING)
    inside = F.when((at < 0) & lowest, 0).otherwise(F.greatest(at, F.lit(-1)))
    flat = F.when(F.col(value) < F.col("_lo"), -1).when(F.col(value) > F.col("_hi"), 1).otherwise(0)
    x = x.withColumn("bin", F.when(F.col("_w") > 0, F.least(inside, bins)).otherwise(flat).cast("int"))
    keys = [group] if group else []
    g = x.groupBy(*keys, "bin").agg(*[F.first(c).alias(c) for c in ("_w", "_first", "_last", "_lo", "_hi")], F.count(F.lit(1)).alias("n"))
    edge = lambda k: F.when(F.col("_w") > 0, (F.col("_first") + F.col("bin") + k) * F.col("_w")).otherwise(F.col("_lo"))
    last = F.when(F.col("_w") > 0, F.col("_last") - F.col("_first")).otherwise(1)
    return g.select(*keys, "bin", F.when(F.col("bin") >= 0, edge(0)).alias("bin_lo"),
                    F.when(F.col("bin") < last, edge(1)).alias("bin_hi"), "n")


def exact_values(df: DataFrame, value: str, out: str = "n") -> DataFrame:
    """Count of rows per distinct value (``GROUP BY value``)."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias(out))
