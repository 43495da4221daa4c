"""An event's contributions stay in one partition."""

from pathlib import Path

import pytest

from emberfield.operators import evidence
from emberfield.plans.tables import Tables

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
def test_contributions_are_shuffled_once_by_event(spark):
    got = evidence.evidence_groups(Tables(spark, str(DATA)).contributions)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(event_id") == 1
