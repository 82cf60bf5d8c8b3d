"""Rows that are few but dear keep their number of tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from layover.functions.gamma import gamma_sf
from layover.operators.spread import spread
from layover.plans import posterior
from layover.plans.registry import JOBS


def test_small_aggregates_are_spread_over_all_partitions(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = spread(spark.range(4000).groupBy((F.col("id") % 2000).alias("k")).agg(F.count(F.lit(1)).alias("n")), "k")
    assert x.rdd.getNumPartitions() >= n


def test_implied_days_of_accounts_evaluate_each_edge_once(air, monkeypatch):
    """Neighbouring bins share an edge: one evaluation a row, of rows dealt over all partitions."""
    calls, seen = [], []
    monkeypatch.setattr(posterior, "gamma_sf", lambda a, x: calls.append(1) or gamma_sf(a, x))
    monkeypatch.setattr(posterior, "spread", lambda df, key: seen.append(spread(df, key)) or seen[-1])
    rows = JOBS["account_implied_days_histogram"](air).collect()
    assert len(calls) == 1
    assert seen and seen[0].rdd.getNumPartitions() >= 8
    for g in {r["has_missed"] for r in rows}:
        assert sum(r["mass"] for r in rows if r["has_missed"] == g) == pytest.approx(1, abs=1e-6)
