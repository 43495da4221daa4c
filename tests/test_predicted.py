"""The best class of an event is found within its row."""

from pyspark.sql import functions as F

from emberfield.plans.tables import Tables


def test_predicted_is_the_best_of_predictions_without_a_shuffle(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    got = t.predicted
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    best = t.predictions.groupBy("event_id").agg(F.max("p").alias("p"))
    ties = t.predictions.join(best.hint("merge"), ["event_id", "p"]).groupBy("event_id", "p").agg(F.min("fire_type").alias("fire_type"))
    want = ties.select("event_id", F.col("fire_type").alias("predicted_fire_type"), F.col("p").alias("confidence"))
    assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
