"""T1: next-booking pairing as a merged per-account timeline.

The reference pairs every booking with every earlier arrival of the same
account (a range join, quadratic per account) and then keeps, twice with
``DISTINCT ON``, the nearest match in each direction.  The surviving pairs
are exactly: a booking whose *immediate predecessor* in the account's
timeline is an arrival, where the timeline holds

* kind 0: distinct booking times (lowest booking id per time), and
* kind 1: distinct arrival times (lowest arrival booking id per time),

ordered by ``(time, kind, id)``.  Bookings sort before arrivals at an
equal time because the join condition is strict (``booking > arrival``).

The events of ordinary accounts are dealt by account once; distinct times and
predecessors follow inside the partitions.  Accounts of very many events take
the parallel-scan ``scanned_previous`` (range-partitioned on account and time,
with a carry table across partitions), so a hot account does not land in a
single task.  Work is linear in the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layover.functions.time import hours_between
from layover.operators import ordered


def next_booking_pairs(bookings: DataFrame, arrivals: DataFrame, key: str = "account_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (arrival, first later booking) with no booking in between.

    ``bookings``: (key, booking_ts, booking_id); ``arrivals``: (key,
    arrival_ts, arrival_id).  Returns key, updat_ts, booking_id,
    actual_arrival, booking_id_2, hours_to_next_booking, and the columns
    ``keep`` of the arrival.
    """
    none = [F.lit(None).cast(arrivals.schema[c].dataType).alias(c) for c in keep]
    ev = bookings.select(key, F.col("booking_ts").alias("t"), F.lit(0).alias("kind"), F.col("booking_id").alias("id"), *none)
    ev = ev.unionByName(arrivals.select(key, F.col("arrival_ts").alias("t"), F.lit(1).alias("kind"), F.col("arrival_id").alias("id"), *keep))

    def distinct(x: DataFrame) -> DataFrame:
        first = F.min(F.struct("id", *keep)) if keep else F.min("id")
        x = x.groupBy(key, "t", "kind").agg(first.alias("_f"))
        return x.select(key, "t", "kind", *[F.col(f"_f.{c}") for c in ("id", *keep)]) if keep else x.withColumnRenamed("_f", "id")

    fields = ["t", "kind", "id"]

    def dealt(x: DataFrame) -> DataFrame:
        lag = F.lag(F.struct(*fields, *keep)).over(Window.partitionBy(key).orderBy(*fields))
        return distinct(x.repartition(key)).withColumn("prev", lag)

    many = ordered.large_keys(ev, [key], ordered.MANY_ROWS)
    if many is None:
        ev = dealt(ev)
    else:
        small, large = ordered.split(ev, [key], many)
        ev = dealt(small).unionByName(ordered.scanned_previous(distinct(large), [key], fields, list(keep)))
    pairs = ev.where((F.col("kind") == 0) & (F.col("prev.kind") == 1))
    return pairs.select(
        key,
        F.col("t").alias("updat_ts"),
        F.col("id").alias("booking_id"),
        F.col("prev.t").alias("actual_arrival"),
        F.col("prev.id").alias("booking_id_2"),
        hours_between(F.col("t"), F.col("prev.t")).alias("hours_to_next_booking"),
        *[F.col(f"prev.{c}").alias(c) for c in keep],
    )


def unmatched_first_booking(bookings: DataFrame, arrivals: DataFrame, key: str = "account_id") -> DataFrame:
    """Per key, the earliest ``(booking_ts, booking_id)`` among bookings with
    no strictly earlier arrival -- the single NULL-arrival row that the
    reference's left join + ``DISTINCT ON (account, arrival)`` keeps."""
    first_arr = arrivals.groupBy(key).agg(F.min("arrival_ts").alias("_first_arr"))
    cand = bookings.join(first_arr, key, "left").where(
        F.col("_first_arr").isNull() | (F.col("booking_ts") <= F.col("_first_arr")))
    best = cand.groupBy(key).agg(F.min(F.struct("booking_ts", "booking_id")).alias("_b"))
    return best.select(key, F.col("_b.booking_ts").alias("updat_ts"), F.col("_b.booking_id").alias("booking_id"))
