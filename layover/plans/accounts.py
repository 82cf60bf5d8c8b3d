"""C. Account, passenger and boarding integrity.

Key-integrity audits are joins and anti/semi joins; the reference's
``LEFT JOIN … WHERE b.k IS NULL`` is a ``left_anti`` join.  The
drill-downs and slices of the reference take their account or slice as a
parameter; by default they run over the whole tables.  ``LIMIT`` survives
only in the two "first n" reports, always behind a total order (Spark
plans ``TakeOrderedAndProject``: a per-partition top-n and a small merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layover.functions.text import dotted_name
from layover.operators.bitmaps import distinct_count, set_counts
from layover.operators.firsts import argmax_ties
from layover.operators.heavy import heavy_join
from layover.operators.ordered import row_index
from layover.operators.sorting import pg_key, pg_sort
from layover.session import remove_scratch
from layover.sources.adapter import Airline

#: by name, then by ids, so that a range sort can split a frequent name
DRILLDOWN_ORDER = ("first_name", "last_name", "passenger_id", "booking_leg_id", "pass_id")
#: legs of a booking, or passes of a passenger, that one row of a drill-down holds before it is sorted
LISTED = 256


def _slice(df: DataFrame, col: str, modulus: int, remainder: int) -> DataFrame:
    return df if modulus == 1 else df.where(F.col(col) % modulus == remainder)


def frequent_flyer_accounts(air: Airline) -> DataFrame:
    a = air.account.select("account_id", F.upper("first_name").alias("first_name"),
                           F.upper("last_name").alias("last_name"), "frequent_flyer_id")
    ff = air.frequent_flyer.select("level", "award_points", "frequent_flyer_id")
    return a.join(ff, "frequent_flyer_id", "inner").select(
        "account_id", "first_name", "last_name", "frequent_flyer_id", "level", "award_points")


def _passenger_names(air: Airline) -> DataFrame:
    return air.passenger.select("account_id", dotted_name().alias("name"))


def account_passenger_names(air: Airline) -> DataFrame:
    return _passenger_names(air).groupBy("account_id", "name").agg(F.count(F.lit(1)).alias("n_trips"))


def account_flight_counts(air: Airline) -> DataFrame:
    p = _passenger_names(air).where(F.col("account_id").isNotNull())
    return pg_sort(p.groupBy("account_id").agg(F.count("name").alias("n_trips")), "n_trips desc", "account_id")


def account_distinct_names(air: Airline) -> DataFrame:
    p = _passenger_names(air).where(F.col("account_id").isNotNull())
    return pg_sort(p.groupBy("account_id").agg(F.countDistinct("name").alias("n_names")), "n_names desc",
                   "account_id")


def _top_passengers(air: Airline) -> DataFrame:
    counts = account_passenger_names(air)
    return argmax_ties(counts, ["account_id"], "n_trips", out_max="max_count")


def _holder_accounts(air: Airline) -> DataFrame:
    a = air.account.select("account_id", dotted_name().alias("name"), "frequent_flyer_id")
    ff = air.frequent_flyer.select("level", "award_points", "frequent_flyer_id")
    return a.join(ff, "frequent_flyer_id", "inner")


def account_top_passenger(air: Airline) -> DataFrame:
    """Frequent-flyer accounts with their most common passenger name(s), ties kept."""
    top = _top_passengers(air).withColumnRenamed("name", "passenger_name")
    return _holder_accounts(air).join(top, "account_id", "inner").select(
        "account_id", "name", "frequent_flyer_id", "level", "award_points", "passenger_name", "n_trips",
        "max_count")


def account_top_passenger_is_holder(air: Airline) -> DataFrame:
    """Same, keeping only accounts whose top passenger is the holder."""
    return _holder_accounts(air).join(_top_passengers(air), ["account_id", "name"], "inner").select(
        "account_id", "name", "frequent_flyer_id", "level", "award_points", "n_trips", "max_count")


def passengers_per_booking(air: Airline) -> DataFrame:
    per = air.passenger.groupBy("booking_id").agg(F.count("passenger_id").alias("n_passengers"))
    return per.groupBy("n_passengers").agg(F.count("n_passengers").alias("n_bookings"))


def booking_count_comparison(air: Airline) -> DataFrame:
    a = air.booking.groupBy("account_id").agg(F.countDistinct("booking_id").alias("book_count"))
    b = air.passenger.groupBy("account_id").agg(F.countDistinct("booking_id").alias("pass_count"))
    return a.join(b, "account_id", "inner")


def passenger_boarding(air: Airline) -> DataFrame:
    p = air.passenger.where(F.col("booking_id").isNotNull()).select(
        "passenger_id", "booking_id", "first_name", "last_name", "account_id")
    bp = air.boarding_pass.select("pass_id", "passenger_id", "booking_leg_id")
    return p.join(bp, "passenger_id", "left")


def passenger_legs(air: Airline) -> DataFrame:
    p = air.passenger.select("passenger_id", "booking_id")
    legs = air.booking_leg.select("booking_id", "flight_id")
    return heavy_join(p, legs, "booking_id")


def passenger_id_coverage(air: Airline) -> DataFrame:
    a = distinct_count(air.passenger, "passenger_id", "n_passenger_ids")
    return a.crossJoin(distinct_count(air.boarding_pass, "passenger_id", "n_boarding_passenger_ids"))


def passenger_boarding_counts(air: Airline) -> DataFrame:
    """Numbers of passengers, of passengers with a boarding pass, and of those
    without one (as ``passengers_without_boarding`` lists them)."""
    c = set_counts(air.passenger, air.boarding_pass, "passenger_id")
    return c.select(F.col("n_a").alias("n_passengers"), F.col("n_both").alias("n_with_boarding"), F.col("n_a_only").alias("n_without_boarding"))


def passengers_without_boarding(air: Airline) -> DataFrame:
    p = air.passenger.select("passenger_id").distinct()
    bp = air.boarding_pass.select("passenger_id")
    return p.join(bp, "passenger_id", "left_anti")


def passengers_without_boarding_detail(air: Airline, floor: int | None = None, n: int | None = None) -> DataFrame:
    """Passenger ids (above ``floor``, if given) with no boarding pass, with details: all, or the first ``n``.
    (The reference used a floor of 8,000,000 on its own ids.)"""
    above = F.lit(True) if floor is None else F.col("passenger_id") > floor
    p = air.passenger.where(F.col("passenger_id").isNotNull() & above).select("passenger_id").distinct()
    bp = air.boarding_pass.where(above).select("passenger_id")
    first = p.join(bp, "passenger_id", "left_anti")
    if n is not None:
        first = first.orderBy("passenger_id").limit(n)
    x = first.join(air.passenger, "passenger_id", "left").select(
        "passenger_id", "booking_id", "first_name", "last_name", "account_id", "update_ts")
    return pg_sort(x, "booking_id", "passenger_id")


def boarding_leg_passenger_sample(air: Airline, n: int | None = None) -> DataFrame:
    """Boarding passes (all, or the first ``n`` by leg id) with their leg and
    the passengers of its booking."""
    bp = air.boarding_pass
    if n is not None:
        bp = bp.orderBy("booking_leg_id", "pass_id").limit(n)
    legs = air.booking_leg.select(
        F.col("booking_leg_id").alias("leg_booking_leg_id"), F.col("booking_id").alias("leg_booking_id"),
        F.col("flight_id").alias("leg_flight_id"), "leg_num", F.col("is_returning").cast("int").alias("leg_is_returning"),
        F.col("update_ts").alias("leg_update_ts"))
    p = air.passenger.select(
        *[F.col(c).alias("p_" + c) for c in ("passenger_id", "booking_id", "first_name", "last_name",
                                              "account_id", "update_ts")])
    x = bp.join(legs, bp.booking_leg_id == legs.leg_booking_leg_id, "left")
    return x.join(p, x.leg_booking_id == p.p_booking_id, "left")


def boarding_legs(air: Airline) -> DataFrame:
    bp = air.boarding_pass.select("pass_id", "passenger_id", "booking_leg_id")
    legs = air.booking_leg.select("booking_leg_id", "booking_id", "flight_id")
    return bp.join(legs, "booking_leg_id", "left")


def passenger_leg_boarding(air: Airline, modulus: int = 1, remainder: int = 0) -> DataFrame:
    """Passengers (of an account slice; all by default), their legs, and the
    boarding passes of each leg (joined on the leg, as in the reference).

    Passes are joined to legs before passengers are: passengers times legs is
    the longer table, and is never dealt.  The legs with their passes are stored,
    which frees the disk that their shuffles held."""
    p = _slice(air.passenger, "account_id", modulus, remainder).select(
        F.col("update_ts").alias("p_update_ts"), "account_id", "first_name", "last_name", "booking_id",
        "passenger_id")
    legs = air.booking_leg.select("booking_id", "flight_id", "leg_num", "booking_leg_id",
                                  F.col("update_ts").alias("leg_update_ts"))
    bp = air.boarding_pass.select("boarding_time", F.col("booking_leg_id").alias("bp_booking_leg_id"),
                                  F.col("passenger_id").alias("bp_passenger_id"), "pass_id",
                                  F.col("update_ts").alias("bp_update_ts"))
    legs, _ = air.store("legs_passes", legs.join(bp, legs.booking_leg_id == bp.bp_booking_leg_id, "left"))
    return heavy_join(p, legs, "booking_id")


def boarding_coverage(air: Airline, modulus: int = 1, remainder: int = 0) -> DataFrame:
    """Rows of ``passenger_leg_boarding`` with and without a pass, counted per
    booking and leg and multiplied: the rows themselves are never made."""
    p = _slice(air.passenger, "account_id", modulus, remainder).groupBy("booking_id").agg(
        F.count(F.lit(1)).alias("_passengers"))
    passes = air.boarding_pass.groupBy("booking_leg_id").agg(F.count(F.lit(1)).alias("_passes"))
    legs = air.booking_leg.select("booking_id", "booking_leg_id").join(passes, "booking_leg_id", "left")
    legs = legs.groupBy("booking_id").agg(F.sum(F.col("_passes").isNull().cast("long")).alias("_bare"),
                                          F.coalesce(F.sum("_passes"), F.lit(0)).alias("_passes"))
    x = p.join(legs, "booking_id", "left")  # a passenger without legs is one row without a pass
    total = lambda c, none: F.coalesce(F.sum(F.col("_passengers") * F.coalesce(c, F.lit(none))), F.lit(0))
    return x.agg(total("_bare", 1).alias("rows_without_pass"), total("_passes", 0).alias("rows_with_pass"))


def account_boarding_drilldown(air: Airline, account_id: int | None = None, modulus: int = 1,
                               remainder: int = 0) -> DataFrame:
    """Passenger legs joined to boarding passes on the passenger id (one
    account when given, else all)."""
    return _by_name(_nested(air, account_id, modulus, remainder, flights=False), flights=False)


def _flight_cols(air: Airline) -> DataFrame:
    return air.flight.select(F.col("flight_id").alias("f_flight_id"), "flight_no", "scheduled_departure",
                             "scheduled_arrival", "departure_airport", "arrival_airport", "status",
                             "aircraft_code", "actual_departure", "actual_arrival")


def _listed(df: DataFrame, key: str, order: tuple[str, ...], out: str, rows: DataFrame) -> DataFrame:
    """Rows of each ``key`` as lists ``out`` of at most ``LISTED`` structs in
    ``order`` (a long key has many lists, so no row holds it whole).  Long keys
    are counted over ``rows``, a plainer frame with the keys of ``df``."""
    fields = [c for c in df.columns if c != key]
    x = row_index(df.where(F.col(key).isNotNull()), [key], order, out="_n", rows=rows.where(F.col(key).isNotNull()))
    x = x.groupBy(key, F.expr(f"(_n - 1) div {LISTED}").alias("_part")).agg(F.sort_array(F.collect_list(F.struct("_n", *fields))).alias(out))
    # whether the key may have other lists: this one is full or not the first
    x = x.withColumn(f"{out}_long", (F.col("_part") > 0) | (F.size(out) >= LISTED)).drop("_part")
    return x.withColumn(out, F.transform(out, lambda r: F.struct(*[r[c].alias(c) for c in fields])))


def _nested(air: Airline, account_id: int | None, modulus: int, remainder: int, flights: bool) -> DataFrame:
    """Passengers with lists ``_legs`` of their legs (with the flights, if
    asked) and ``_passes`` of their boarding passes: the pairs of legs and
    passes are made after sorting, not before.  A passenger with more passes
    than a list holds has one leg a row, so that rows still sort by leg, then
    pass.

    Legs with their flights are wide, so they are dealt by booking once and
    passengers come to them with their passes.  Each step is stored, which
    frees the disk that its shuffles held before the sort writes its own."""
    p = _slice(air.passenger, "account_id", modulus, remainder).select(
        F.col("update_ts").alias("p_update_ts"), "account_id", "first_name", "last_name", "booking_id", "passenger_id")
    p = p if account_id is None else p.where(F.col("account_id") == account_id)
    bp = air.boarding_pass.select("boarding_time", F.col("booking_leg_id").alias("bp_booking_leg_id"),
                                  F.col("passenger_id").alias("bp_passenger_id"), "pass_id", F.col("update_ts").alias("bp_update_ts"))
    bp = _listed(bp, "bp_passenger_id", ("pass_id", "bp_booking_leg_id", "boarding_time", "bp_update_ts"), "_passes", bp)
    p, root = air.store("passengers_passes", p.join(bp, p.passenger_id == bp.bp_passenger_id, "left").drop("bp_passenger_id"))
    legs = air.booking_leg.select("booking_id", "flight_id", "leg_num", "booking_leg_id", F.col("update_ts").alias("leg_update_ts"))
    rows = legs
    if flights:
        f = _flight_cols(air)
        legs = legs.join(f, legs.flight_id == f.f_flight_id, "left").drop("f_flight_id")
    legs = _listed(legs, "booking_id", ("booking_leg_id", "leg_num", "flight_id"), "_legs", rows)
    x = heavy_join(p, legs, "booking_id")
    long = F.coalesce("_passes_long", F.lit(False)) & F.col("_legs").isNotNull()
    parts = F.when(long, F.transform("_legs", lambda leg: F.array(leg))).otherwise(F.array("_legs"))
    x, _ = air.store("passengers_legs", x.withColumn("_legs", F.explode(parts)).drop("_legs_long", "_passes_long"))
    remove_scratch(air.spark, root)
    return x


#: columns of the lists
LEG = ("flight_id", "leg_num", "booking_leg_id", "leg_update_ts")
PASS = ("boarding_time", "bp_booking_leg_id", "pass_id", "bp_update_ts")


def _columnar(x: DataFrame, items: str, fields: tuple[str, ...]) -> DataFrame:
    """A list of structs as one list a field: numbers alike lie side by side, so
    that they take less space in a shuffle (texts, as of flights, take more)."""
    return x.select(*[c for c in x.columns if c != items], *[F.col(items)[c].alias(c) for c in fields])


def _zipped(x: DataFrame, items: str, fields: tuple[str, ...]) -> DataFrame:
    """Undoes ``_columnar``."""
    return x.select(*[c for c in x.columns if c not in fields], F.arrays_zip(*fields).alias(items))


def _with_leg(x: DataFrame) -> DataFrame:
    x = x.withColumn("_leg", F.explode_outer("_legs"))
    return x.select(*[c for c in x.columns if c not in ("_legs", "_leg")], "_leg.*")


def _with_pass(x: DataFrame) -> DataFrame:
    x = _zipped(x, "_passes", PASS).withColumn("_pass", F.explode_outer("_passes"))
    own = F.when(F.col("_pass").isNotNull(), F.col("passenger_id")).alias("bp_passenger_id")
    return x.select(*[c for c in x.columns if c not in ("_passes", "_pass")], own, "_pass.*")


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0)).asc_nulls_last()


def _by_name(x: DataFrame, flights: bool) -> DataFrame:
    """One row a passenger, leg and pass, in ``DRILLDOWN_ORDER``."""
    x = _columnar(x, "_passes", PASS)
    x, leg = (x, F.col("_legs")["booking_leg_id"]) if flights else (_columnar(x, "_legs", LEG), F.col("booking_leg_id"))
    x = x.orderBy(*[pg_key(c) for c in ("first_name", "last_name", "passenger_id")], _first(leg), _first(F.col("pass_id")))
    return _with_pass(_with_leg(x if flights else _zipped(x, "_legs", LEG)))


def account_flight_drilldown(air: Airline, account_id: int | None = None, modulus: int = 1,
                             remainder: int = 0) -> DataFrame:
    return _by_name(_nested(air, account_id, modulus, remainder, flights=True), flights=True)


def slice_flight_drilldown(air: Airline, modulus: int = 1, remainder: int = 0) -> DataFrame:
    """The whole slice with flights (the reference orders it by flight number)."""
    x = _columnar(_with_leg(_nested(air, None, modulus, remainder, flights=True)), "_passes", PASS)
    x = x.orderBy(*[pg_key(c) for c in ("flight_no", "scheduled_departure", "passenger_id", "booking_leg_id")], _first(F.col("pass_id")))
    return _with_pass(x)


def booking_leg_ts_agreement(air: Airline, modulus: int = 1, remainder: int = 0) -> DataFrame:
    """Bookings whose leg update time equals the booking's update time."""
    b = _slice(air.booking, "account_id", modulus, remainder)
    legs = air.booking_leg.select("booking_id", "booking_leg_id", "flight_id", "leg_num", "is_returning",
                                  F.col("update_ts").alias("leg_update_ts"))
    x = b.join(legs, "booking_id", "inner")
    return x.where(F.col("update_ts") == F.col("leg_update_ts"))
