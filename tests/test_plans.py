"""Plan guards for every registered job: no cartesian product and no Python
evaluation anywhere in the physical plan (see scripts/audit_plans.py)."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as E
from layover.plans.registry import JOBS
from tests.conftest import SF_SMALL

FORBIDDEN = re.compile(r"CartesianProduct|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas")


@pytest.mark.parametrize("name", sorted(JOBS))
def test_plan_has_no_cartesian_product_or_python(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not FORBIDDEN.search(plan), FORBIDDEN.search(plan).group(0)
