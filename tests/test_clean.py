"""Cleaning: one pass over the rows, and ids as before."""

import random

from pyspark.sql import functions as F

from emberfield.functions.detections import four_decimals
from emberfield.operators import clean
from emberfield.plans.tables import Tables


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_four_decimals_are_those_of_a_format(spark):
    rng = random.Random(3)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1e-5, -1e-5, 5e-5, -5e-5, 1.5e-4, 1.00005, -1.00005, 1e8 + 0.5, 1e9, 1e300]
    values = odd + [rng.uniform(-180, 180) for _ in range(2000)] + [rng.randrange(-1800000, 1800000) / 1e4 + 5e-5 for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert df.filter(~four_decimals(F.col("x")).eqNullSafe(F.format_string("%.4f", "x"))).count() == 0


def test_clean_deals_rows_out_once_and_keeps_the_same_rows(spark):
    raw = Tables(spark, "/root/testdata/sf0.001").raw
    raw = raw.unionByName(raw.withColumn("acq_time", F.lit(2575))).unionByName(raw.withColumn("latitude", F.lit(50.0)))
    got = clean.clean(raw)
    assert exchanges(got) == 1
    want = clean.dedup_event_id(clean.dedup_exact(clean.in_region(clean.derived(clean.standardized(raw)))))
    assert got.count() > 0 and got.select(want.columns).exceptAll(want).count() == 0 and want.exceptAll(got.select(want.columns)).count() == 0
