"""A. Fleet and route exploration.

Aggregations over ``flight`` (partial aggregation before the shuffle),
joined to the small ``aircraft``/``airport`` dimensions.  No broadcast
hint is forced on the dimensions: Catalyst broadcasts them when their
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and AQE
re-plans from runtime sizes, so the size check is Spark's own.  Per-route
window extremes of the reference become ``groupBy(route)`` aggregates
joined back (the grouped tables are small).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layover.functions.text import route
from layover.operators.sorting import pg_sort
from layover.sources.adapter import Airline

#: flight counts to leave out of the route spread tables (outliers of one dataset; none by default)
EXCLUDED_FLIGHT_COUNTS: tuple[int, ...] = ()


def _flights_aircraft(air: Airline) -> DataFrame:
    f = air.flight.select("flight_id", "flight_no", "departure_airport", "arrival_airport", "aircraft_code")
    a = air.aircraft.select("code", "model", "range", "class")
    return f.join(a, f.aircraft_code == a.code, "left")


def aircraft_usage(air: Airline) -> DataFrame:
    return air.flight.groupBy("aircraft_code").agg(F.count(F.lit(1)).alias("n_flights"))


def flight_no_aircraft_types(air: Airline) -> DataFrame:
    g = air.flight.groupBy("flight_no").agg(F.countDistinct("aircraft_code").alias("n_aircraft_types"))
    return pg_sort(g, "n_aircraft_types desc", "flight_no")


def airport_pair_flight_nos(air: Airline) -> DataFrame:
    g = air.flight.groupBy("arrival_airport", "departure_airport").agg(
        F.countDistinct("flight_no").alias("n_flight_nos"))
    return pg_sort(g, "n_flight_nos desc", "arrival_airport", "departure_airport")


def route_flight_nos(air: Airline) -> DataFrame:
    g = air.flight.groupBy("departure_airport", "arrival_airport").agg(
        F.countDistinct("flight_no").alias("n_flights_per_route"))
    return g.withColumn("route", route())


def route_flight_no_histogram(air: Airline) -> DataFrame:
    return route_flight_nos(air).groupBy("n_flights_per_route").agg(F.count(F.lit(1)).alias("n_routes"))


def aircraft_range_usage(air: Airline) -> DataFrame:
    g = _flights_aircraft(air).groupBy("aircraft_code", "range", "class").agg(
        F.count(F.lit(1)).alias("n_flights"))
    return pg_sort(g, "n_flights desc", "aircraft_code")


def route_model_usage(air: Airline) -> DataFrame:
    """Flights per route, model and range (the reference counts a column its
    subquery does not project; rows are counted)."""
    x = _flights_aircraft(air).withColumn("route", route())
    return x.groupBy("route", "model", "range").agg(F.count(F.lit(1)).alias("n_flights"))


def route_range_spread(air: Airline) -> DataFrame:
    """Distinct (route, model, range) with the route's min, max and spread of range."""
    g = _flights_aircraft(air).withColumn("route", route()).select("route", "model", "range").distinct()
    per = g.groupBy("route").agg(F.min("range").alias("min_range"), F.max("range").alias("max_range"))
    x = g.join(per, "route", "left").withColumn("range_diff", F.col("max_range") - F.col("min_range"))
    return pg_sort(x, "range_diff desc", "route", "model")


def _route_aircraft_counts(air: Airline, excluded: Sequence[int]) -> DataFrame:
    f = air.flight.withColumn("route", route())
    a = f.groupBy("route", "aircraft_code").agg(F.count("flight_no").alias("flight_count"))
    ac = air.aircraft.select("code", "range")
    x = a.join(ac, a.aircraft_code == ac.code, "left").drop("code")
    return x.where(~F.col("flight_count").isin(list(excluded))) if excluded else x


def route_flight_count_spread(air: Airline, excluded: Sequence[int] = EXCLUDED_FLIGHT_COUNTS) -> DataFrame:
    x = _route_aircraft_counts(air, excluded)
    per = x.groupBy("route").agg(F.max("flight_count").alias("max_flight"), F.min("flight_count").alias("min_flight"),
                                 (F.max("range") - F.min("range")).alias("diff"))
    x = x.join(per, "route", "left").select("route", "flight_count", "aircraft_code", "range",
                                            "max_flight", "min_flight", "diff")
    return pg_sort(x, "diff desc", "route", "aircraft_code")


def route_range_spread_grouped(air: Airline, excluded: Sequence[int] = EXCLUDED_FLIGHT_COUNTS) -> DataFrame:
    x = _route_aircraft_counts(air, excluded).select("route", "flight_count", "aircraft_code", "range").distinct()
    per = x.groupBy("route").agg(F.max("range").alias("max_range"), F.min("range").alias("min_range"))
    x = x.join(per, "route", "left").withColumn("range_diff", F.col("max_range") - F.col("min_range"))
    return pg_sort(x, "range_diff desc", "route", "aircraft_code")


def flights_with_airports(air: Airline) -> DataFrame:
    """Flights with city and time zone of both airports (airport in two roles)."""
    ap = air.airport
    dep = ap.select(F.col("airport_code").alias("dep_code"), F.col("city").alias("dep_city"),
                    F.col("airport_tz").alias("dep_tz"))
    arr = ap.select(F.col("airport_code").alias("arr_code"), F.col("city").alias("arr_city"),
                    F.col("airport_tz").alias("arr_tz"))
    f = air.flight
    return (f.join(dep, f.departure_airport == dep.dep_code, "left")
            .join(arr, f.arrival_airport == arr.arr_code, "left"))
