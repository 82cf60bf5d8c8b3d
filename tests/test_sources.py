"""S2-S4: CSV round trip with an explicit schema, table sink, scratch cleanup."""

from __future__ import annotations

import os
import uuid

from layover.oracle.compare import same
from layover.session import checkpoint_dir, register_scratch
from layover.sources.files import read_csv, save_table, write_csv


def test_csv_round_trip_keeps_types(spark):
    df = spark.createDataFrame(
        [(1, "2000-01-01 10:00:00", 1.5, None), (2, None, None, "x,y")],
        "id LONG, ts STRING, v DOUBLE, s STRING").selectExpr("id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "v", "s")
    path = register_scratch(spark, f"{checkpoint_dir(spark)}/test-csv-{uuid.uuid4().hex}")
    write_csv(df, path)
    back = read_csv(spark, path, "id LONG, ts TIMESTAMP_NTZ, v DOUBLE, s STRING")
    assert back.schema == df.schema
    ok, why = same(back.toPandas(), df.toPandas())
    assert ok, why


def test_save_table_reads_back(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    path = register_scratch(spark, f"{checkpoint_dir(spark)}/test-ctas-{uuid.uuid4().hex}")
    back = save_table(df, path=path)
    assert back.count() == 100 and back.agg({"k": "max"}).first()[0] == 6
    assert os.path.isdir(path.removeprefix("file:"))


def test_stage_is_per_job(stored_air):
    a, b = stored_air.fork(), stored_air.fork()
    x = a.stage("t", lambda: a.booking.limit(3))
    assert a.stage("t", lambda: 1 / 0) is x       # memoised inside one job context
    assert "t" not in b._staged                     # not shared with another job
