"""Operators whose groups may be large: sweeps, folds, medians, snapshots."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.operators import clean, history, quantiles
from emberfield.sources import files


def test_latest_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for cell in range(12):
        for i in range(rng.choice([1, 3, 40, 300])):
            minutes = rng.randrange(0, 60 * 24 * 3, 10 if cell % 3 else 400)
            sat = "N20" if cell % 4 == 0 else rng.choice(["N20", "N21"])
            rows.append((cell, start + dt.timedelta(minutes=minutes), sat, 20 + cell + rng.uniform(0, 0.04), 80 + rng.uniform(0, 0.04), f"e{cell}_{i}"))
    rows.append((99, None, "N20", 1.0, 1.0, "x"))
    det = spark.createDataFrame(rows, "grid_id long, timestamp timestamp, satellite string, latitude double, longitude double, event_id string")
    order = F.struct(F.col("at"), -F.col("at2"), -F.col("km"))
    want = {r["grid_id"]: (r["k"], r["h"]) for r in history.corroboration_pairs(det).groupBy("grid_id").agg(
        F.max_by("km", order).alias("k"), F.max_by("hours", order).alias("h")).collect()}
    assert len(want) > 3
    for block in (1, 16, 10_000):
        got = {r["grid_id"]: (r["m"]["km"], r["m"]["hours"]) for r in history.latest_pairs(det, block=block).collect()}
        assert got == want
    assert history.latest_pairs(det.limit(0)).count() == 0


@pytest.mark.parametrize("small", [4, 1024])
def test_grouped_median_equals_numpy(spark, small):
    rng = np.random.default_rng(2)
    groups = {1: [3.0], 2: [1.0, 2.0], 3: [5.0] * 50, 4: rng.lognormal(0, 5, 3001).tolist(), 5: np.round(rng.normal(300, 9, 2000), 1).tolist(),
              6: [0.0] * 999 + [1e300] * 1001, 7: [-1e-300, 1e300, 0.0, 7.0] * 40, 8: [1.0] * 600 + [2.0] * 600}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [(1, None), (9, None)]
    df = spark.createDataFrame(rows, "g long, v double")
    got = dict(quantiles.grouped_median(df, "g", "v", small=small, slots=8).collect())
    assert got == pytest.approx({g: float(np.median(v)) for g, v in groups.items()}, rel=1e-15)


def detections(spark, rows):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start.date(), "N20", start + dt.timedelta(seconds=s), q, i, k, f"e{i}") for i, (s, q, k) in enumerate(rows)]
    return spark.createDataFrame(rows, "grid_id long, date date, satellite string, timestamp timestamp, data_quality string, source_id long, brightness double, event_id string")


def test_blocks_fold_as_one(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(0, 6 * 3600), rng.choice(["NRT", "ARCHIVE"]), rng.choice([300.0, 310.0, 330.0, None])) for _ in range(700)]
    df = detections(spark, rows)
    kept = [sorted(r[0] for r in clean.dedup_near(df, block=b).select("source_id").collect()) for b in (1, 7, 256, 10_000)]
    last, want = None, []
    order = df.orderBy("timestamp", "data_quality", "source_id").select("timestamp", "data_quality", "brightness", "source_id").collect()
    for t, q, k, i in order:
        close = last is not None and (t - last[0]).total_seconds() <= 600 and k is not None and last[2] is not None and abs(k - last[2]) <= 15
        if close and q == "ARCHIVE" and last[1] != "ARCHIVE":
            want[-1], last = i, (t, q, k)
        elif not close:
            want.append(i)
            last = (t, q, k)
    assert all(x == sorted(want) for x in kept)


def test_a_long_run_of_one_cell_and_day_ends_in_seconds(spark):
    # No gap, and every row is kept: brightness jumps.
    df = spark.range(50_000).select(
        F.lit(1).cast("long").alias("grid_id"), F.lit("2024-01-01").cast("date").alias("date"), F.lit("N20").alias("satellite"),
        F.timestamp_seconds(1704067200 + F.col("id")).alias("timestamp"), F.lit("NRT").alias("data_quality"), F.col("id").alias("source_id"),
        (300 + 50 * (F.col("id") % 2)).cast("double").alias("brightness"), F.concat(F.lit("e"), "id").alias("event_id"),
    )
    began = time.perf_counter()
    assert clean.dedup_near(df).count() == 50_000
    assert time.perf_counter() - began < 60


def test_snapshot_documents_are_bounded(spark, tmp_path):
    rows = spark.range(5000).select(F.when(F.col("id") < 4500, "2024-01-01").otherwise("2024-01-02").cast("date").alias("day"), F.col("id").cast("string").alias("id"))
    files.write_nested(files.snapshot_documents(rows, "day", 400), str(tmp_path / "s"))
    read = files.read_snapshot(spark, str(tmp_path / "s"))
    assert read.agg(F.max(F.size("observations"))).first()[0] <= 400
    back = files.explode_snapshot(read).select("from_date", "id").collect()
    assert sorted(int(r["id"]) for r in back) == list(range(5000)) and sum(r["from_date"] == "2024-01-01" for r in back) == 4500
