"""D. Booking behaviour: lead times, booking dates, missed connections.

``booking_lead_days_export`` is the CSV sink of the reference (``COPY …
CSV HEADER``) followed by the CSV source its R code reads: the frame is
written with a header to the shared checkpoint folder and read back with
an explicit schema (never inferred).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layover.functions.time import days_between, minutes_between, seconds_between
from layover.operators.histogram import equal_width
from layover.operators.sorting import pg_sort
from layover.plans.retention import MISSED_MINUTES, leg_gaps, non_censored_flights
from layover.sources.adapter import Airline
from layover.sources.files import read_csv, write_csv
from layover.session import checkpoint_dir, register_scratch

#: booking-date split of the before/after comparison (fixture default)
SPLIT_DATE = "1998-05-15"
#: minimum passenger-legs of an account in the lead-time summary
MIN_ACCOUNT_LEGS = 100


def _lead(air: Airline) -> DataFrame:
    legs = air.booking_leg.select("booking_id", "flight_id", F.col("update_ts").alias("booking_time"))
    f = air.flight.select("flight_id", "actual_departure")
    x = legs.join(f, "flight_id", "left").where(F.col("actual_departure").isNotNull())
    return x.withColumn("early_days", F.round(days_between("actual_departure", "booking_time"), 0))


LEAD_ORDER = ("early_days", "booking_id", "flight_id")


def _lead_rows(air: Airline) -> DataFrame:
    return _lead(air).select("booking_id", "flight_id", "actual_departure", "booking_time", "early_days")


def booking_lead_days(air: Airline) -> DataFrame:
    return pg_sort(_lead_rows(air), *LEAD_ORDER)


LEAD_SCHEMA = ("booking_id BIGINT, flight_id BIGINT, actual_departure TIMESTAMP_NTZ, "
               "booking_time TIMESTAMP_NTZ, early_days DOUBLE")


def booking_lead_days_export(air: Airline, path: str | None = None) -> DataFrame:
    """Write ``booking_lead_days`` as CSV with a header, read it back."""
    out = path or register_scratch(
        air.spark, f"{checkpoint_dir(air.spark)}/exports/booking_lead_days-{uuid.uuid4().hex}")
    # a sort by ranges reads its input twice, for the bounds and for the rows: the joined rows are stored
    rows = air.stage("booking_lead_days", lambda: _lead_rows(air))
    write_csv(pg_sort(rows, *LEAD_ORDER), out)  # sorted by lead days, as the reference's COPY
    return read_csv(air.spark, out, LEAD_SCHEMA)


def account_lead_days(air: Airline, min_count: int = MIN_ACCOUNT_LEGS) -> DataFrame:
    """Per (passenger) account: mean/max/min lead days over its passenger-legs."""
    x = _lead(air).where(seconds_between("actual_departure", "booking_time") > 0)
    p = air.passenger.select("booking_id", "account_id")
    g = x.join(p, "booking_id", "inner").groupBy("account_id").agg(
        F.round(F.avg("early_days"), 6).alias("avg_early_days"), F.max("early_days").alias("max_early_days"),
        F.min("early_days").alias("min_early_days"), F.count(F.lit(1)).alias("n_legs"))
    return pg_sort(g.where(F.col("n_legs") > min_count), "avg_early_days desc", "account_id")


def bookings_per_day(air: Airline) -> DataFrame:
    day = F.to_date("update_ts").cast("timestamp_ntz")  # the day, as a midnight timestamp
    return pg_sort(air.booking.groupBy(day.alias("booking_date")).agg(
        F.count(F.lit(1)).alias("n_bookings")), "booking_date")


def lead_days_before_after(air: Airline, split_date: str = SPLIT_DATE) -> DataFrame:
    """Counts of lead days (to scheduled departure, from the booking date) for
    bookings before and after a split date, side by side."""
    legs = air.booking_leg.select("flight_id", F.to_date("update_ts").alias("booking_time"))
    bt = F.col("booking_time").cast("timestamp_ntz")
    f = air.flight.select(F.col("flight_id").alias("_fid"), "scheduled_departure")
    x = legs.join(f, (legs.flight_id == f._fid) & (seconds_between(f.scheduled_departure, bt) > 0), "left")
    x = x.withColumn("early_days", F.round(days_between("scheduled_departure", bt), 0))
    split = F.lit(split_date).cast("date")
    x = x.select(F.when(F.col("booking_time") < split, F.col("early_days")).alias("early_days_before_june"),
                 F.when(F.col("booking_time") >= split, F.col("early_days")).alias("early_days_after_may"))
    before = x.groupBy("early_days_before_june").agg(F.count(F.lit(1)).alias("before_june_count"))
    after = x.groupBy("early_days_after_may").agg(F.count(F.lit(1)).alias("after_may_count"))
    x = before.join(after, before.early_days_before_june == after.early_days_after_may, "left")
    return pg_sort(x, "early_days_before_june")


def missed_connections(air: Airline) -> DataFrame:
    """Per leg: minutes since the previous leg's arrival; the booking is
    flagged when any gap is under five minutes."""
    g = leg_gaps(air)
    # min(gap) over (partition by booking_id) as a partial aggregate joined back
    flags = g.groupBy("booking_id").agg(F.min("mins_since_last_flight_arrival").alias("_min_gap"))
    x = g.join(flags, "booking_id", "left")
    x = x.select("booking_id", "flight_id", "leg_num", "actual_departure", "actual_arrival",
                 "mins_since_last_flight_arrival",
                 F.when(F.col("_min_gap") < MISSED_MINUTES, F.lit("Missed_flight"))
                  .otherwise(F.lit("Made_flight")).alias("missed_flight_flag"))
    return pg_sort(x, "booking_id", "leg_num", "flight_id")


def delayed_flight_customers(air: Airline, n: int | None = None) -> DataFrame:
    """Delayed arrivals (all, or the ``n`` most delayed) with their bookings, passengers and accounts."""
    f = air.flight.where(F.col("actual_arrival").isNotNull()
                         & (seconds_between("actual_arrival", "scheduled_arrival") > 0))
    f = f.select("flight_id", F.to_date("scheduled_departure").cast("timestamp_ntz").alias("scheduled_departure_date"),
                 "scheduled_arrival", "departure_airport", "arrival_airport", "actual_departure", "actual_arrival",
                 F.round(minutes_between("actual_arrival", "scheduled_arrival"), 0).alias("arrival_delay_minutes"))
    top = f if n is None else f.orderBy(F.col("arrival_delay_minutes").desc(), "flight_id").limit(n)
    legs = air.booking_leg.select("booking_id", F.col("flight_id").alias("flght_id"))
    p = air.passenger.select("passenger_id", F.col("booking_id").alias("book_id"), "account_id")
    b = air.booking.select(F.col("booking_id").alias("b_booking_id"),
                           F.col("account_id").alias("booking_account_id"), "update_ts")
    x = top.join(legs, top.flight_id == legs.flght_id, "left").drop("flght_id")
    x = x.join(p, x.booking_id == p.book_id, "left")
    x = x.join(b, x.book_id == b.b_booking_id, "left").drop("book_id", "b_booking_id")
    return pg_sort(x.where(F.col("update_ts").isNotNull()), "update_ts desc", "flight_id", "passenger_id")


def lead_days_histogram(air: Airline, bins: int = 30) -> DataFrame:
    """Histogram of positive booking lead days (the reference's early_days > 0)."""
    return equal_width(_lead(air).where(F.col("early_days") > 0), "early_days", bins)


def hours_to_next_histogram(air: Airline, bins: int = 30) -> DataFrame:
    """Histogram of observed hours from an arrival to the next booking."""
    return equal_width(non_censored_flights(air), "hours_to_next_booking", bins)
