"""Airline schema derived from the driver's TPC-H-style tables.

The jobs are written against nine airline tables (flight, aircraft,
airport, account, frequent_flyer, passenger, booking, booking_leg,
boarding_pass).  The test data ships TPC-H tables instead, so this module
derives the airline tables from them by fixed, documented rules
(``FIXTURES.md``).  The same rules are written in SQL as the oracle's CTE
prefix (``layover.oracle.prefix``).

On real airline data, build an :class:`Airline` directly from the nine
tables with :meth:`Airline.from_frames` and every job runs unchanged.

Scale notes
-----------
* ``leg_num`` is a per-order row number, computed by the parallel-scan
  ``row_index`` so that no single task has to hold a huge order.
* ``flight`` columns are pure functions of ``flight_id``; the table is the
  distinct flight ids of the legs (a partial aggregate, skew-safe).
* ``passenger`` is a narrow ``explode`` of orders; ``boarding_pass`` is an
  equi-join of passengers and legs on ``booking_id``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layover.functions.time import add_minutes
from layover.operators.ordered import row_index
from layover.sources.tables import read_table

# ---------------------------------------------------------------------------
# Fixed values of the fixture derivation (must equal the oracle prefix).
# ---------------------------------------------------------------------------
EPOCH = "1995-01-01 00:00:00"          # day zero of flight schedules
FUTURE_CUTOFF = "2001-05-01 00:00:00"   # flights departing later have no actual times
ID_STEP = 1_000_000                     # ids of legs and flights: this many a booking or supplier
LEAD_DAYS = 14                          # minimum days from booking to first leg
ROUTE_NUMBERS = 4                       # a route has 1..4 flight numbers per supplier
AIRCRAFT_TYPES = 12                     # flights use codes AC0..AC11; every part is an aircraft row
DELAYED_H = (700, 899)                  # hash range of delayed flights (delay = h - 700 minutes)
CANCELED_H = (940, 949)                 # hash range of canceled flights
SWAPPED_H = (950, 979)                  # hash range of flights with swapped actual times
SHORT_H = 980                           # hash from which arrival is 5 minutes after departure
NO_ACCOUNT_MOD = 11                     # orders with key % 11 = 0 have passengers without account
FREQUENT_FLYER_MOD = 3                  # customers with key % 3 = 0 are frequent flyers
NAME_MOD = 50                           # first names Fn0..Fn49


def _airport_code(n: Column) -> Column:
    return F.concat(F.lit("N"), F.lpad(n.cast("string"), 2, "0"))


def _ts(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


class Airline:
    """Lazily derived airline tables (each one a DataFrame plan)."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, frames: dict | None = None,
                 exports: dict | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames = {} if frames is None else frames
        self._staged: dict[str, DataFrame] = {}
        self._exports: dict[str, DataFrame] = {} if exports is None else exports

    # -- per-job staging -------------------------------------------------------
    def fork(self) -> "Airline":
        """A fresh job context over the same tables (staged results not shared)."""
        a = Airline(self.spark, self.sf_dir, self._frames, exports=self._exports)
        for name in TABLES:
            if name in self.__dict__:
                a.__dict__[name] = self.__dict__[name]
        return a

    def export(self, name: str, build) -> DataFrame:
        """Compute ``build()`` once for these tables and keep it as Parquet in the
        shared checkpoint folder; shared by every job context forked from the
        same tables.  This is the reference's export step (its SQL writes the
        survival inputs once and every model reads them)."""
        if name not in self._exports:
            import uuid

            from layover.session import checkpoint_dir, register_scratch, write_stage

            root = register_scratch(self.spark, f"{checkpoint_dir(self.spark)}/export-{uuid.uuid4().hex}")
            write_stage(build(), f"{root}/{name}")
            self._exports[name] = self.spark.read.parquet(f"{root}/{name}")
        return self._exports[name]

    def staged(self, name: str) -> DataFrame | None:
        """The result staged under ``name`` in this job context, if any."""
        return self._staged.get(name)

    def stage(self, name: str, build) -> DataFrame:
        """Compute ``build()`` once in this job context and store it as Parquet in
        the shared checkpoint folder; later uses in the job scan the stored copy
        (column pruning, filter pushdown, real statistics, and lineage cut so a
        lost executor does not replay the whole pipeline)."""
        if name not in self._staged:
            self._staged[name], _ = self.store(name, build())
        return self._staged[name]

    def store(self, name: str, df: DataFrame) -> tuple[DataFrame, str]:
        """``df`` stored as Parquet in the shared checkpoint folder, and the folder
        (for ``remove_scratch`` once nothing reads it any more)."""
        import uuid

        from layover.session import checkpoint_dir, register_scratch, write_stage

        root = register_scratch(self.spark, f"{checkpoint_dir(self.spark)}/stage-{uuid.uuid4().hex}")
        write_stage(df, f"{root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{root}/{name}"), root

    # -- construction --------------------------------------------------------
    @classmethod
    def from_dir(cls, spark: SparkSession, sf_dir: str) -> "Airline":
        return cls(spark, sf_dir=sf_dir)

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> "Airline":
        """Use ready airline tables (real data or hand-written test frames)."""
        return cls(spark, frames=frames)

    def _raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def _given(self, name: str):
        return self._frames.get(name)

    # -- tables --------------------------------------------------------------
    @cached_property
    def booking(self) -> DataFrame:
        if (g := self._given("booking")) is not None:
            return g
        return self._raw("orders").select(
            F.col("o_orderkey").alias("booking_id"),
            F.col("o_custkey").alias("account_id"),
            F.col("o_orderdate").alias("update_ts"),
        )

    @cached_property
    def booking_leg(self) -> DataFrame:
        if (g := self._given("booking_leg")) is not None:
            return g
        # lines of an order alike in line number and supplier give the same legs in any order
        li = self._raw("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
        li = row_index(li, keys=["l_orderkey"], order=["l_linenumber", "l_suppkey"], out="leg_num")
        o = self._raw("orders").select("o_orderkey", "o_orderdate")
        legs = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
        d = (F.datediff(F.to_date("o_orderdate"), F.to_date(_ts(EPOCH))).cast("long")
             + F.lit(LEAD_DAYS) + F.col("o_orderkey") % 60 + F.col("leg_num"))
        return legs.select(
            (F.col("l_orderkey") * ID_STEP + F.col("leg_num")).alias("booking_leg_id"),
            F.col("l_orderkey").alias("booking_id"),
            (F.col("l_suppkey") * ID_STEP + d).alias("flight_id"),
            F.col("leg_num").cast("int").alias("leg_num"),
            (F.col("leg_num") % 2 == 0).alias("is_returning"),
            F.col("o_orderdate").alias("update_ts"),
        )

    @cached_property
    def flight(self) -> DataFrame:
        if (g := self._given("flight")) is not None:
            return g
        ids = self.booking_leg.select("flight_id").distinct()
        base = ids.select(
            "flight_id",
            F.expr(f"flight_id div {ID_STEP}").alias("sk"),
            (F.col("flight_id") % ID_STEP).alias("d"),
            ((F.col("flight_id") * 7919) % 1000).alias("h"),
        )
        h, skc, d = F.col("h"), F.col("sk"), F.col("d")
        sched_dep = add_minutes(_ts(EPOCH), d * 1440 + (skc * 37) % 1440)
        base = base.select(
            "flight_id", "sk", "h",
            sched_dep.alias("scheduled_departure"),
            add_minutes(sched_dep, 60 + (skc * 7) % 400).alias("scheduled_arrival"),
            F.when(h.between(*DELAYED_H), h - DELAYED_H[0]).otherwise(F.lit(0)).alias("delay"),
        )
        canceled = h.between(*CANCELED_H)
        no_actual = canceled | (F.col("scheduled_departure") >= _ts(FUTURE_CUTOFF))
        swapped = h.between(*SWAPPED_H)
        short = h >= SHORT_H
        sd, sa, delay = F.col("scheduled_departure"), F.col("scheduled_arrival"), F.col("delay")
        actual_dep = (F.when(no_actual, F.lit(None).cast("timestamp_ntz"))
                      .when(swapped, sa).when(short, sd).otherwise(add_minutes(sd, delay)))
        actual_arr = (F.when(no_actual, F.lit(None).cast("timestamp_ntz"))
                      .when(swapped, sd).when(short, add_minutes(sd, 5)).otherwise(add_minutes(sa, delay)))
        return base.select(
            "flight_id",
            (skc * 10 + h % (1 + skc % ROUTE_NUMBERS)).cast("string").alias("flight_no"),
            "scheduled_departure",
            "scheduled_arrival",
            _airport_code(skc % 25).alias("departure_airport"),
            _airport_code((skc + 1 + F.expr("sk div 25") % 24) % 25).alias("arrival_airport"),
            F.when(canceled, F.lit("Canceled")).when(delay > 0, F.lit("Delayed"))
             .otherwise(F.lit("On schedule")).alias("status"),
            F.concat(F.lit("AC"), ((skc + F.when(h % 5 == 0, 7).otherwise(0)) % AIRCRAFT_TYPES)
                     .cast("string")).alias("aircraft_code"),
            actual_dep.alias("actual_departure"),
            actual_arr.alias("actual_arrival"),
        )

    @cached_property
    def aircraft(self) -> DataFrame:
        if (g := self._given("aircraft")) is not None:
            return g
        return (self._raw("part").select(
            F.concat(F.lit("AC"), F.col("p_partkey").cast("string")).alias("code"),
            F.col("p_name").alias("model"),
            (F.lit(1000) + F.col("p_size") * 100).cast("int").alias("range"),
            F.col("p_type").alias("class"),
        ))

    @cached_property
    def airport(self) -> DataFrame:
        if (g := self._given("airport")) is not None:
            return g
        n = self._raw("nation").select("n_nationkey", "n_name", "n_regionkey")
        r = self._raw("region").select("r_regionkey", "r_name")
        return n.join(r, n.n_regionkey == r.r_regionkey, "inner").select(
            _airport_code(F.col("n_nationkey")).alias("airport_code"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("airport_tz"),
        )

    @cached_property
    def account(self) -> DataFrame:
        if (g := self._given("account")) is not None:
            return g
        c = F.col("c_custkey")
        return self._raw("customer").select(
            c.alias("account_id"),
            F.concat(F.lit("Fn"), (c % NAME_MOD).cast("string")).alias("first_name"),
            F.concat(F.lit("Ln"), c.cast("string")).alias("last_name"),
            F.when(c % FREQUENT_FLYER_MOD == 0, c).alias("frequent_flyer_id"),
        )

    @cached_property
    def frequent_flyer(self) -> DataFrame:
        if (g := self._given("frequent_flyer")) is not None:
            return g
        return (self._raw("customer").where(F.col("c_custkey") % FREQUENT_FLYER_MOD == 0).select(
            F.col("c_custkey").alias("frequent_flyer_id"),
            F.col("c_mktsegment").alias("level"),
            F.floor(F.col("c_acctbal") * 100).cast("int").alias("award_points"),
        ))

    @cached_property
    def passenger(self) -> DataFrame:
        if (g := self._given("passenger")) is not None:
            return g
        o = self._raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        o = o.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 3)))
        return o.select(
            (F.col("o_orderkey") * 10 + F.col("i")).alias("passenger_id"),
            F.col("o_orderkey").alias("booking_id"),
            F.when(F.col("o_orderkey") % NO_ACCOUNT_MOD != 0, F.col("o_custkey")).alias("account_id"),
            F.concat(F.lit("Fn"), ((F.col("o_custkey") + F.col("i") * 17) % NAME_MOD).cast("string"))
             .alias("first_name"),
            F.concat(F.lit("Ln"), F.col("o_custkey").cast("string")).alias("last_name"),
            F.col("o_orderdate").alias("update_ts"),
        )

    @cached_property
    def boarding_pass(self) -> DataFrame:
        if (g := self._given("boarding_pass")) is not None:
            return g
        p = self.passenger.select("passenger_id", "booking_id")
        legs = self.booking_leg.select("booking_leg_id", "booking_id", "flight_id")
        f = self.flight.where(F.col("actual_departure").isNotNull()).select("flight_id", "actual_departure")
        flown = legs.join(f, "flight_id", "inner")
        bt = add_minutes(F.col("actual_departure"), -30)
        return p.join(flown, "booking_id", "inner").select(
            (F.col("booking_leg_id") * 10 + F.col("passenger_id") % 10).alias("pass_id"),
            "passenger_id",
            "booking_leg_id",
            bt.alias("boarding_time"),
            bt.alias("update_ts"),
        )


TABLES = ("booking", "booking_leg", "flight", "aircraft", "airport", "account", "frequent_flyer",
          "passenger", "boarding_pass")  # in dependency order

#: tables that are aggregated or joined from others, what from, and the order they are stored in
#: (tightens Parquet min/max statistics); the rest are projections of one scan and stay such
_WRITTEN = {"booking_leg": ((), "booking_id"), "boarding_pass": (("booking_leg",), "booking_leg_id")}

_STORED: dict[tuple[str, str], Airline] = {}


class StoredTables:
    """The airline tables of ``air``, each derived on its first use, so that a
    job pays for the tables that it reads.

    Legs and boarding passes are written as Parquet under ``root`` (the ETL step
    of a real deployment, where these are base tables).  A flight is nothing but
    its id and columns that follow from it, so flights are the distinct ids of
    the stored legs: joins on the id deal ids instead of whole flights."""

    def __init__(self, air: Airline, root: str):
        self._air, self._root, self._frames = air, root, {}

    def get(self, name: str) -> DataFrame:
        if name not in self._frames:
            needs, order = _WRITTEN.get(name, (("booking_leg",) if name == "flight" else (), None))
            for t in needs:
                self.get(t)
            df = getattr(self._air, name)
            if order:
                from layover.session import write_stage

                path = f"{self._root}/{name}"
                write_stage(df.sortWithinPartitions(order), path)
                df = self._air.spark.read.parquet(path)
                self._air.__dict__[name] = df  # later tables derive from the stored one
            self._frames[name] = df
        return self._frames[name]


def stored(spark: SparkSession, sf_dir: str) -> Airline:
    """The airline tables of ``sf_dir``, derived at most once per application
    and kept in the shared checkpoint folder."""
    import os
    import uuid

    from layover.session import checkpoint_dir, deal_by_size, register_scratch

    deal_by_size(spark, *[read_table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")])
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _STORED:
        root = register_scratch(spark, f"{checkpoint_dir(spark)}/airline-{uuid.uuid4().hex}")
        _STORED[key] = Airline(spark, frames=StoredTables(Airline.from_dir(spark, sf_dir), root))
    return _STORED[key]


def load(spark: SparkSession, sf_dir: str) -> Airline:
    return Airline.from_dir(spark, sf_dir)
