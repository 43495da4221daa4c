"""The split deals no class to one task."""

from pyspark.sql import functions as F

from emberfield.operators import model


def test_no_rows_are_dealt_out_by_their_class_alone(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("event_id"), F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("fire_type"))
    out = model.split_stratified(df)
    # Small partitions are not put together, as large ones would not be.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = out.rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(tasks) < 0.6 * sum(tasks)
    assert {(r[0], r[1]): r[2] for r in out.groupBy("fire_type", "part").count().collect()} == {("a", "test"): 392, ("a", "train"): 1568, ("b", "test"): 8, ("b", "train"): 32}
