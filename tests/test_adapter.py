"""The Spark adapter and the SQL prefix derive identical airline tables."""

import pytest

from layover.oracle.compare import same
from layover.oracle.prefix import with_prefix
from layover.sources.adapter import TABLES, Airline
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", TABLES)
def test_adapter_table_matches_sql(spark, duck, name):
    air = Airline.from_dir(spark, SF_SMALL)
    got = getattr(air, name).toPandas()
    want = duck.execute(with_prefix(f"SELECT * FROM {name}")).df()
    ok, why = same(got, want)
    assert ok, why


def test_adapter_counts(spark):
    air = Airline.from_dir(spark, SF_SMALL)
    assert air.booking_leg.count() == 6000
    assert air.flight.count() == 5309
    assert air.flight.where("actual_arrival is null").count() == 345
    assert air.flight.where("actual_arrival < actual_departure").count() == 148
    assert air.aircraft.count() == 200 and air.airport.count() == 25


def test_leg_numbers_consecutive(spark):
    air = Airline.from_dir(spark, SF_SMALL)
    g = air.booking_leg.groupBy("booking_id").agg({"leg_num": "max", "*": "count"}).toPandas()
    assert (g["max(leg_num)"] == g["count(1)"]).all()
