"""B. Flight-time data quality.

Durations are exact microsecond differences scaled to minutes.  The
50-tile table uses the range-partitioned global index (``operators.
ranking``) instead of an unpartitioned ``ntile`` window; histograms are
built as binned counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layover.functions.text import route
from layover.functions.time import minutes_between, seconds_between
from layover.operators.histogram import equal_width
from layover.operators.ranking import ntile
from layover.operators.sorting import pg_sort
from layover.sources.adapter import Airline

TILES = 50
RATIO_BINS = 500


def _durations(air: Airline) -> DataFrame:
    f = air.flight
    return f.select(
        "flight_id", "status", "scheduled_departure", "scheduled_arrival", "actual_departure", "actual_arrival",
        route().alias("route"),
        minutes_between("scheduled_arrival", "scheduled_departure").alias("schedule_length"),
        minutes_between("actual_arrival", "actual_departure").alias("flight_mins"),
    )


def flight_length_ntiles(air: Airline, tiles: int = TILES) -> DataFrame:
    """Min and max flight length (minutes) in each of ``tiles`` equal-count tiles."""
    d = _durations(air).where(F.col("actual_arrival").isNotNull()).select("flight_id", "flight_mins")
    t = ntile(d, ["flight_mins", "flight_id"], tiles, out="nt")
    g = t.groupBy("nt").agg(F.min("flight_mins").alias("min_length"), F.max("flight_mins").alias("max_length"))
    return pg_sort(g, "nt")


def _negative(air: Airline) -> DataFrame:
    f = air.flight
    return f.where(f.actual_departure.isNotNull()
                   & (seconds_between("actual_arrival", "actual_departure") < 0))


def negative_duration_routes(air: Airline) -> DataFrame:
    g = _negative(air).groupBy(route().alias("route")).agg(F.count(F.lit(1)).alias("n_flights"))
    return pg_sort(g, "n_flights desc", "route")


def arrival_delay_histogram(air: Airline) -> DataFrame:
    f = air.flight.where(F.col("actual_arrival").isNotNull())
    d = F.round(minutes_between("actual_arrival", "scheduled_arrival"), 0).alias("arrival_delay_minutes")
    return pg_sort(f.groupBy(d).agg(F.count(F.lit(1)).alias("n_flights")), "arrival_delay_minutes")


def negative_duration_status(air: Airline) -> DataFrame:
    return _negative(air).groupBy("status").agg(F.count(F.lit(1)).alias("n_flights"))


def negative_duration_deltas(air: Airline) -> DataFrame:
    return _negative(air).select(
        "flight_id",
        minutes_between("actual_arrival", "scheduled_arrival").alias("arriv_diff_minutes"),
        minutes_between("actual_departure", "scheduled_departure").alias("depart_diff_minutes"))


def swapped_time_flights(air: Airline) -> DataFrame:
    """Arrival delta equal to minus the departure delta (on-time flights match too)."""
    f = air.flight.select(
        "flight_id", "actual_arrival", "scheduled_arrival", "actual_departure", "scheduled_departure",
        minutes_between("actual_arrival", "scheduled_arrival").alias("arr"),
        minutes_between("actual_departure", "scheduled_departure").alias("dep"))
    return f.where(F.col("arr") == -F.col("dep"))


def route_error_proportion(air: Airline) -> DataFrame:
    """Per route and schedule length: negative-duration counts and extremes,
    non-negative counts and extremes of the route, and the error share."""
    d = _durations(air).where(F.col("actual_arrival").isNotNull())
    neg = d.where(seconds_between("actual_arrival", "actual_departure") < 0)
    pos = d.where(seconds_between("actual_arrival", "actual_departure") >= 0)
    neg_route = neg.groupBy("route").agg(F.min("flight_mins").alias("min_length_under_0"),
                                         F.max("flight_mins").alias("max_length_under_0"))
    aa = neg.groupBy("route", "schedule_length").agg(F.count(F.lit(1)).alias("count_flight_mins_under_0"))
    aa = aa.join(neg_route, "route", "inner")
    bb = pos.groupBy("route").agg(F.count(F.lit(1)).alias("count_flight_mins_over_0"),
                                  F.min("flight_mins").alias("min_length_over_0"),
                                  F.max("flight_mins").alias("max_length_over_0"))
    x = aa.join(bb, "route", "left")
    u, o = F.col("count_flight_mins_under_0"), F.col("count_flight_mins_over_0")
    x = x.select("route", "schedule_length", "count_flight_mins_under_0", "min_length_under_0",
                 "max_length_under_0", "count_flight_mins_over_0", "min_length_over_0", "max_length_over_0",
                 (u / (u + o).cast("double")).alias("proportion_error"))
    return pg_sort(x, "proportion_error desc", "route", "schedule_length")


def route_durations(air: Airline, route_label: str | None = None) -> DataFrame:
    """Scheduled and actual minutes per flight (of one route when given)."""
    d = _durations(air).where(F.col("actual_departure").isNotNull())
    if route_label is not None:
        d = d.where(F.col("route") == route_label)
    return d.select("flight_id", "route", F.col("schedule_length").alias("scheduled_length"),
                    F.col("flight_mins").alias("flight_length"))


def duration_ratio(air: Airline) -> DataFrame:
    """(actual - scheduled) / scheduled length; NULL for a zero schedule."""
    d = _durations(air).where(F.col("actual_departure").isNotNull())
    return d.select("flight_id", F.try_divide(F.col("flight_mins") - F.col("schedule_length"),
                                              F.col("schedule_length")).alias("ratio_length"))


def duration_ratio_histogram(air: Airline, bins: int = RATIO_BINS, lo: float | None = None,
                             hi: float | None = None) -> DataFrame:
    return equal_width(duration_ratio(air), "ratio_length", bins, lo, hi)


def route_duration_histogram(air: Airline, bins: int = 40, route_label: str | None = None) -> DataFrame:
    """Histogram of actual flight minutes (of one route when given)."""
    return equal_width(route_durations(air, route_label), "flight_length", bins)
