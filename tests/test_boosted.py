"""Boosted trees of all classes at once, against one fit per class."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from emberfield.operators import boosted, model

FEATURES = ("a", "b", "flag", "same")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 1500
    a, b = rng.normal(size=n), rng.integers(0, 24, n)
    kind = np.where(a + rng.normal(0, 0.5, n) > 0.6, "x", np.where((b + rng.integers(0, 6, n)) % 24 > 12, "y", "z"))
    values = [(str(i), str(k), float(p), int(q), int(q % 7 == 0), 1.0) for i, (k, p, q) in enumerate(zip(kind, a, b, strict=True))]
    return spark.createDataFrame(values, "event_id string, fire_type string, a double, b int, flag int, same double")


def test_the_same_as_one_fit_per_class(rows):
    got = model.train_boosted(rows, FEATURES, rounds=4, depth=3)
    own = {r[0]: r[1] for r in boosted.probabilities(got, rows, "event_id").collect()}
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).coalesce(1)
    for k, name in enumerate(got.names):
        trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=4, maxDepth=3, stepSize=0.4, seed=42)
        labelled = x.withColumn("label", (F.col("fire_type") == name).cast("double"))
        want = trees.fit(labelled).transform(labelled).select("event_id", vector_to_array("probability")[1]).collect()
        assert max(abs(own[i][k] - p) for i, p in want) < 1e-9


def test_passes_do_not_grow_with_classes(spark, rows):
    sc = spark.sparkContext
    jobs = []
    for n in (2, 12):
        group = f"boosted-{n}"
        sc.setJobGroup(group, group)
        many = rows.withColumn("fire_type", F.concat(F.lit("c"), (F.col("event_id").cast("int") % n).cast("string")))
        model.train_boosted(many, FEATURES, rounds=2, depth=2)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(group)))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2


def test_blocks_and_order_of_rows_change_nothing_but_rounding(rows, monkeypatch):
    whole = {r[0]: r[1] for r in boosted.probabilities(model.train_boosted(rows, FEATURES, rounds=3), rows, "event_id").collect()}
    monkeypatch.setattr(boosted, "BLOCK_ROWS", 50)
    dealt = model.train_boosted(rows.repartition(7, "b"), FEATURES, rounds=3)
    for i, p in boosted.probabilities(dealt, rows, "event_id").collect():
        assert np.allclose(whole[i], p, atol=1e-9)


def test_a_class_alone_and_no_rows(spark, rows):
    one = model.train_boosted(rows.filter("fire_type = 'x'"), FEATURES, rounds=2, depth=2)
    assert {r[0] for r in model.score_boosted(one, rows).select("predicted_fire_type").collect()} == {"x"}
    none = model.train_boosted(rows.limit(0), FEATURES)
    assert model.score_boosted(none, rows.limit(0)).count() == 0
