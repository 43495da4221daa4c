"""Fits on evenly dealt rows."""

from pyspark.sql import functions as F

from emberfield.operators import model


def test_rows_are_dealt_evenly_whatever_they_are_read_as(spark):
    df = spark.range(10_000).select(F.col("id").cast("string").alias("event_id")).coalesce(1)
    sizes = model.dealt(df, most=1000).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 1500
