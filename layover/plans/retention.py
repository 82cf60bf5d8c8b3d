"""E. Retention features: trips, next-booking pairs, censoring.

by booking once for the lag and the reduction to one row per booking
(bookings of very many legs by a parallel scan); bookings get their running count per account from the
parallel-scan running sum; the next-booking pairs come from the merged
timeline (``operators.asof``).  Whole-table extremes are one-row scalar
aggregates attached by broadcast.  No window is partitioned by a single
account, and no window is unpartitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layover.functions.time import days_between, hours_between, minutes_between
from layover.operators.asof import next_booking_pairs, unmatched_first_booking
from layover.operators.bounds import attach, scalar_row
from layover.operators.firsts import argmax_ties
from layover.operators.ordered import large_keys, row_index, running_sum, scanned_previous, split
from layover.operators.sorting import pg_sort
from layover.sources.adapter import Airline

#: a connection shorter than this (minutes, rounded) counts as missed
MISSED_MINUTES = 5
#: a booking of more legs is not windowed in one task
MANY_LEGS = 10_000
#: order of the legs inside a booking; the id decides between equal numbers
LEG_ORDER = ("leg_num", "booking_leg_id")


# ---------------------------------------------------------------------------
# Building blocks
# ---------------------------------------------------------------------------
def leg_flights(air: Airline) -> DataFrame:
    """booking_leg LEFT JOIN flight (one row per leg)."""
    legs = air.booking_leg.select("booking_id", "leg_num", "booking_leg_id", "flight_id")
    f =air.flight.select("flight_id", "scheduled_departure", "scheduled_arrival",
                          "actual_departure", "actual_arrival")
    return legs.join(f, "flight_id", "left")


def leg_gaps(air: Airline) -> DataFrame:
    """Per leg: ``round(minutes(actual_departure - lag(actual_arrival)), 0)``.

    The lag inside a booking is over ``LEG_ORDER``, so gaps and repeats in
    the leg numbers are allowed.  Legs are dealt by booking once, and the
    aggregate per booking that follows uses the same partitions.  Bookings of
    more than ``MANY_LEGS`` legs, counted beforehand over the ids alone, take
    the parallel scan instead, so no window groups a large booking into one
    task.
    """
    legs = leg_flights(air)
    many = large_keys(air.booking_leg, ["booking_id"], MANY_LEGS)
    if many is None:
        g = _lagged(legs)
    else:
        small, large = split(legs, ["booking_id"], many)
        scan = scanned_previous(large, ["booking_id"], list(LEG_ORDER), ["actual_arrival"], out="_prev")
        scan = scan.withColumns({"_arrived": F.col("_prev.actual_arrival"), "_latest": F.lit(None).cast("timestamp_ntz")}).drop("_prev")
        g = _lagged(small).unionByName(scan)
    return g.withColumn("mins_since_last_flight_arrival",
                        F.round(minutes_between(F.col("actual_departure"), F.col("_arrived")), 0)).drop("_arrived")


def _lagged(legs: DataFrame) -> DataFrame:
    """Legs with the arrival of the booking's previous leg, and the latest of
    its arrivals (unknown to the legs that are scanned)."""
    booking = Window.partitionBy("booking_id")
    return legs.withColumns({"_arrived": F.lag("actual_arrival").over(booking.orderBy(*LEG_ORDER)),
                             "_latest": F.max("actual_arrival").over(booking)})


LAST_LEG_COLUMNS = ("flight_id", "scheduled_departure", "scheduled_arrival", "actual_departure", "actual_arrival",
                    "mins_since_last_flight_arrival")


def _booking_summary(air: Airline) -> DataFrame:
    """One row per booking with legs: missed flag, leg count, the last leg, and
    the legs that arrive last (NULL for bookings of very many legs)."""
    g = leg_gaps(air)
    late = F.when(F.col("actual_arrival") == F.col("_latest"), F.struct("flight_id", "scheduled_arrival"))
    s = g.groupBy("booking_id").agg(
        F.max("actual_arrival").alias("max_arrival"),
        F.when(F.count("_latest") > 0, F.collect_list(late)).alias("last_legs"),
        F.min("mins_since_last_flight_arrival").alias("_min_gap"),
        F.count(F.lit(1)).alias("n_legs"),
        F.max(F.struct(*LEG_ORDER, *LAST_LEG_COLUMNS)).alias("_last"),
    ).select("booking_id", "max_arrival", "last_legs", "_min_gap", "n_legs", *["_last." + c for c in LAST_LEG_COLUMNS])
    return s.select(
        "booking_id",
        F.when(F.col("_min_gap") < MISSED_MINUTES, 1).otherwise(0).cast("int").alias("missed_flight_flag"),
        F.col("n_legs").cast("long").alias("n_legs"),
        *LAST_LEG_COLUMNS, "max_arrival", "last_legs",
    )


def flight_time_bounds(air: Airline) -> DataFrame:
    """One row: min and max scheduled departure over all legs' flights."""
    lf = leg_flights(air)
    return scalar_row(lf, min_flight_time=F.min("scheduled_departure"),
                      max_flight_time=F.max("scheduled_departure"))


def trips_full(air: Airline) -> DataFrame:
    """``trips`` plus internal columns (leg count, last flight id), exported
    once for these tables and read by every retention job (the core table
    the reference re-derives in each of its queries)."""
    return air.export("trips", lambda: _trips_full(air))


def _trips_full(air: Airline) -> DataFrame:
    b = air.booking.select("booking_id", "account_id", "update_ts")
    b = running_sum(b, ["account_id"], "update_ts", out="cumulative_bookings", total="_n_account")
    t = b.join(_booking_summary(air), "booking_id", "left")
    return t.select(
        "account_id", "booking_id",
        F.col("update_ts").alias("updat_ts"),
        "scheduled_departure", "scheduled_arrival", "actual_departure", "actual_arrival",
        "mins_since_last_flight_arrival",
        F.coalesce("missed_flight_flag", F.lit(0)).cast("int").alias("missed_flight_flag"),
        "cumulative_bookings",
        (F.col("_n_account") - F.col("cumulative_bookings")).alias("remaining_bookings"),
        F.coalesce("n_legs", F.lit(1)).alias("n_legs"),
        "flight_id", "max_arrival", "last_legs",
    )


TRIPS_COLUMNS = ["account_id", "booking_id", "updat_ts", "scheduled_departure", "scheduled_arrival",
                 "actual_departure", "actual_arrival", "mins_since_last_flight_arrival",
                 "missed_flight_flag", "cumulative_bookings", "remaining_bookings"]


# ---------------------------------------------------------------------------
# Jobs
# ---------------------------------------------------------------------------
def trips(air: Airline) -> DataFrame:
    """One row per booking: last leg's times, missed flag, cumulative and
    remaining bookings of the account.  (Computed directly: as a job on its
    own, each intermediate is used once, so nothing is staged.)"""
    return _trips_full(air).select(*TRIPS_COLUMNS)


def _dataset_columns(t: DataFrame, air: Airline) -> DataFrame:
    """Attach flight-time bounds and day offsets from the dataset's start/end."""
    b = scalar_row(t, _ts_min=F.min("updat_ts"), _ts_max=F.max("updat_ts")).crossJoin(flight_time_bounds(air))
    x = attach(t, b)
    return x.withColumns({
        "days_since_start_of_dataset": F.round(days_between("updat_ts", "_ts_min"), 0),
        "days_to_end_of_dataset": F.round(days_between("_ts_max", "updat_ts"), 0),
        "days_since_first_flight": F.round(days_between("scheduled_departure", "min_flight_time"), 0),
        "days_to_last_flight": F.round(days_between("max_flight_time", "scheduled_departure"), 0),
    }).drop("_ts_min", "_ts_max")


def account_booking_rates(air: Airline, only_missed: bool = True) -> DataFrame:
    """Trips with dataset offsets, cumulative missed flights and four booking
    rates; by default only missed trips, as in the reference."""
    t = trips_full(air)
    t = running_sum(t, ["account_id"], "updat_ts", value=F.col("missed_flight_flag"),
                    out="cumulative_missed_flights_by_account")
    t = _dataset_columns(t, air)
    rate = lambda num, den: F.col(num) / F.greatest(F.lit(1.0), F.col(den))
    t = t.select(
        "account_id", "booking_id", "updat_ts", "cumulative_bookings", "actual_departure", "actual_arrival",
        "remaining_bookings", "missed_flight_flag", "scheduled_departure", "scheduled_arrival",
        F.col("n_legs").cast("int").alias("max_rn"), "mins_since_last_flight_arrival",
        "min_flight_time", "max_flight_time", "days_since_start_of_dataset", "days_to_end_of_dataset",
        F.col("n_legs").cast("int").alias("row_number"), "cumulative_missed_flights_by_account",
        "days_since_first_flight", "days_to_last_flight",
        rate("cumulative_bookings", "days_since_start_of_dataset").alias("booking_rate_so_far"),
        rate("cumulative_bookings", "days_since_first_flight").alias("booking_rate_since_first_flight"),
        rate("remaining_bookings", "days_to_end_of_dataset").alias("rate_remaining"),
        rate("remaining_bookings", "days_to_last_flight").alias("rate_to_last_flight"),
    )
    return t.where(F.col("missed_flight_flag") == 1) if only_missed else t


def booking_rate_summary(air: Airline) -> DataFrame:
    """Mean booking rate before and after a missed flight (over missed trips),
    and the mean rate of accounts that never missed (bookings per dataset day)."""
    r = account_booking_rates(air, only_missed=False)
    missed = r.where(F.col("missed_flight_flag") == 1).agg(
        F.count(F.lit(1)).alias("n_missed_trips"),
        F.round(F.avg("booking_rate_so_far"), 6).alias("rate_before_miss"),
        F.round(F.avg("rate_remaining"), 6).alias("rate_after_miss"),
    )
    span = scalar_row(r, _days=F.round(days_between(F.max("updat_ts"), F.min("updat_ts")), 0))
    acc = r.groupBy("account_id").agg(F.count(F.lit(1)).alias("_n"), F.max("missed_flight_flag").alias("_m"))
    none = attach(acc.where(F.col("_m") == 0), span).agg(
        F.count(F.lit(1)).alias("n_accounts_no_miss"),
        F.round(F.avg(F.col("_n") / F.greatest(F.lit(1.0), F.col("_days"))), 6).alias("rate_no_miss"),
    )
    return missed.crossJoin(none)


def _booking_events(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    bookings = t.select("account_id", F.col("updat_ts").alias("booking_ts"), "booking_id")
    arrivals = t.where(F.col("actual_arrival").isNotNull()).select(
        "account_id", F.col("actual_arrival").alias("arrival_ts"), F.col("booking_id").alias("arrival_id"), "missed_flight_flag")
    return bookings, arrivals


def _next_flight(air: Airline, missed_only_unmatched: bool) -> DataFrame:
    t = trips_full(air)
    bookings, arrivals = _booking_events(t)
    pairs = next_booking_pairs(bookings, arrivals)
    if missed_only_unmatched:
        bookings = t.where(F.col("missed_flight_flag") == 1).select(
            "account_id", F.col("updat_ts").alias("booking_ts"), "booking_id")
    lone = unmatched_first_booking(bookings, arrivals).select(
        "account_id", "updat_ts", "booking_id",
        F.lit(None).cast("timestamp_ntz").alias("actual_arrival"),
        F.lit(None).cast("long").alias("booking_id_2"),
        F.lit(None).cast("double").alias("hours_to_next_booking"))
    rows = pairs.unionByName(lone)
    ee = _dataset_columns(t, air).select(
        "booking_id", "remaining_bookings", "missed_flight_flag", "scheduled_departure", "scheduled_arrival",
        "min_flight_time", "max_flight_time", "days_since_start_of_dataset", "days_to_end_of_dataset")
    return rows.join(ee, "booking_id", "inner")


def time_to_next_flight_2(air: Airline) -> DataFrame:
    """Next-booking pairs with the preceding trip's booking id; one
    unmatched row (no earlier arrival) per account."""
    x = _next_flight(air, missed_only_unmatched=False)
    x = x.select("account_id", "updat_ts", "actual_arrival", "hours_to_next_booking", "booking_id",
                 "booking_id_2", "remaining_bookings", "missed_flight_flag", "scheduled_departure",
                 "scheduled_arrival", "min_flight_time", "max_flight_time", "days_since_start_of_dataset",
                 "days_to_end_of_dataset")
    return pg_sort(x, "account_id", "updat_ts", "hours_to_next_booking")


def time_to_next_flight(air: Airline) -> DataFrame:
    """As ``time_to_next_flight_2`` but unmatched rows only for missed bookings
    (the reference filters ``hours IS NOT NULL OR missed_flight_flag = 1``)."""
    x = _next_flight(air, missed_only_unmatched=True)
    x = x.select("account_id", "updat_ts", "actual_arrival", "hours_to_next_booking", "booking_id",
                 "remaining_bookings", "missed_flight_flag", "scheduled_departure", "scheduled_arrival",
                 "min_flight_time", "max_flight_time", "days_since_start_of_dataset", "days_to_end_of_dataset")
    return pg_sort(x, "account_id", "updat_ts", "hours_to_next_booking")


def time_to_next_pairs(air: Airline) -> DataFrame:
    """The draft form: account, booking time, previous arrival, hours."""
    t = trips_full(air)
    bookings, arrivals = _booking_events(t)
    pairs = next_booking_pairs(bookings, arrivals).select(
        "account_id", "updat_ts", "actual_arrival", "hours_to_next_booking")
    lone = unmatched_first_booking(bookings, arrivals).select(
        "account_id", "updat_ts", F.lit(None).cast("timestamp_ntz").alias("actual_arrival"),
        F.lit(None).cast("double").alias("hours_to_next_booking"))
    return pg_sort(pairs.unionByName(lone), "account_id", "updat_ts", "hours_to_next_booking")


def non_censored_flights(air: Airline, with_arrival: bool = False) -> DataFrame:
    """Observed durations: each pair with the flag of the *preceding* trip."""
    bookings, arrivals = _booking_events(trips_full(air))
    cols = ["account_id", "hours_to_next_booking", "missed_flight_flag"] + (["actual_arrival"] if with_arrival else [])
    return next_booking_pairs(bookings, arrivals, keep=("missed_flight_flag",)).select(*cols)


def time_to_next_by_ordinal(air: Airline) -> DataFrame:
    """The ordinal-matching draft: booking k of an account is matched to the
    arrival whose rank equals 1 + the number of own arrivals before it."""
    t = trips_full(air)
    trips = t
    mx = t.groupBy("account_id").agg(F.max("actual_arrival").alias("_max_arr"))
    t = t.join(mx, "account_id", "left").withColumn(
        "actual_arrival_filled", F.coalesce("actual_arrival", "_max_arr")).drop("_max_arr")
    t = running_sum(t, ["account_id"], "updat_ts",
                    value=F.when(F.col("updat_ts") > F.col("actual_arrival_filled"), 1).otherwise(0),
                    out="_c", rows=trips)
    t = t.withColumn("count_2", F.col("_c") + 1)
    t = row_index(t, ["account_id"], ["actual_arrival_filled", "booking_id"], out="rn", rows=trips)
    ee = t.select("account_id", "updat_ts", "count_2", "mins_since_last_flight_arrival")
    vv = t.select("account_id", F.col("rn").cast("long").alias("count_2"), F.col("rn"), "actual_arrival_filled")
    j = ee.join(vv, ["account_id", "count_2"], "inner").where(
        F.col("updat_ts") > F.col("actual_arrival_filled"))
    return j.select("account_id", "updat_ts", "actual_arrival_filled", "count_2", "rn",
                    "mins_since_last_flight_arrival",
                    hours_between("updat_ts", "actual_arrival_filled").alias("hours_to_next_booking"))


def _account_legs(air: Airline) -> DataFrame:
    """account JOIN booking LEFT JOIN legs LEFT JOIN flight (leg level)."""
    acc = air.account.select("account_id")
    b = air.booking.select("account_id", "booking_id", "update_ts")
    legs = air.booking_leg.select("booking_id", "flight_id", "leg_num")
    f = air.flight.select("flight_id", "scheduled_arrival", "actual_arrival", "actual_departure")
    return acc.join(b, "account_id", "inner").join(legs, "booking_id", "left").join(f, "flight_id", "left")


def last_flight_by_account(air: Airline) -> DataFrame:
    """Each account's last arrived leg(s), ties kept, with the dataset end."""
    x = _account_legs(air).where(F.col("actual_arrival").isNotNull())
    best = argmax_ties(x.select("account_id", "booking_id", "flight_id", "actual_arrival"),
                       ["account_id"], "actual_arrival", out_max="max_arrival")
    end = scalar_row(air.booking, end_of_dataset=F.max("update_ts"))
    return attach(best, end).select("account_id", "booking_id", "flight_id", "actual_arrival",
                                    "max_arrival", "end_of_dataset")


def censored_accounts(air: Airline) -> DataFrame:
    """Legs carrying an account's last arrival when it is later than the
    account's last booking (the right-censored observations)."""
    t = trips_full(air)
    per = t.groupBy("account_id").agg(F.max("updat_ts").alias("max_booking"), F.max("max_arrival").alias("max_arrival_by_account"))
    per = per.where(F.col("max_arrival_by_account") > F.col("max_booking")).join(air.account.select("account_id"), "account_id")
    x = t.select("account_id", "booking_id", F.col("updat_ts").alias("update_ts"), F.col("max_arrival").alias("actual_arrival"),
                 "missed_flight_flag", "last_legs")
    x = x.join(per.withColumn("actual_arrival", F.col("max_arrival_by_account")), ["account_id", "actual_arrival"], "inner")
    # the flag is that of the whole booking, as in ``trips``: one booking has one flag
    rows = x.withColumn("_leg", F.explode("last_legs")).select("*", "_leg.*").drop("_leg", "last_legs")
    if not t.where(F.col("max_arrival").isNotNull() & F.col("last_legs").isNull()).isEmpty():
        # bookings of very many legs: their last legs are looked up
        f = air.flight.select("flight_id", "scheduled_arrival", "actual_arrival")
        legs = air.booking_leg.select("booking_id", "flight_id").join(f, "flight_id")
        more = x.where(F.col("last_legs").isNull()).drop("last_legs")
        rows = rows.unionByName(more.join(legs, ["booking_id", "actual_arrival"]))
    ends = scalar_row(air.booking, end_of_dataset=F.max("update_ts")).crossJoin(
        scalar_row(air.flight, last_flight=F.max("actual_arrival")))
    rows = attach(rows, ends)
    return rows.select(
        F.lit(1).alias("censored_id"), "account_id", "booking_id", "flight_id", "update_ts", "max_booking",
        "max_arrival_by_account", "actual_arrival", "scheduled_arrival", "end_of_dataset", "last_flight",
        F.coalesce("missed_flight_flag", F.lit(0)).cast("int").alias("missed_flight_flag"))


def _observed(air: Airline) -> DataFrame:
    """The observed part of the survival events."""
    obs = non_censored_flights(air, with_arrival=True)
    return obs.select("account_id", "missed_flight_flag", F.lit(0).alias("censored_id"),
                      (F.col("hours_to_next_booking") / 24.0).alias("days"), "actual_arrival")


def _censored(air: Airline, observed: DataFrame) -> DataFrame:
    """The censored part: only of accounts with an observed duration."""
    cens = censored_accounts(air).join(observed.select("account_id").distinct(), "account_id", "left_semi")
    return cens.select("account_id", "missed_flight_flag", F.lit(1).alias("censored_id"),
                       (hours_between("last_flight", "actual_arrival") / 24.0).alias("days"), "actual_arrival")


def survival_export(air: Airline) -> DataFrame:
    """The survival events (``survival_table`` plus the arrival that starts each
    duration) as exported once for the rate models (the reference's export step
    between its SQL and its models): the observed rows, and the censored ones."""
    observed = air.export("survival_observed", lambda: _observed(air))
    return observed.unionByName(air.export("survival_censored", lambda: _censored(air, observed)))


def survival_table(air: Airline) -> DataFrame:
    """Observed (censored_id 0) and censored (1) durations in days;
    censored rows only for accounts with an observed duration."""
    x = survival_export(air).drop("actual_arrival")
    return pg_sort(x, "account_id", "censored_id", "days")


def survival_table_ctas(air: Airline) -> DataFrame:
    """The survival table kept as a table of its own (``CREATE TABLE AS``) and
    read back from there."""
    import uuid

    from layover.session import checkpoint_dir, register_scratch
    from layover.sources.files import save_table

    path = register_scratch(air.spark, f"{checkpoint_dir(air.spark)}/table-{uuid.uuid4().hex}")
    return save_table(survival_export(air).drop("actual_arrival"), path=path)
