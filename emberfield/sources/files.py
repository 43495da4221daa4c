"""File sources and sinks: detection CSV, snapshot and infrastructure JSON, Parquet, nested JSON."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RAW_TEXT, align_schema, standardize_columns


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one in local mode where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="emberfield-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to a new shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_detections(spark: SparkSession, paths: Sequence[str], schema: T.StructType = RAW_TEXT) -> DataFrame:
    """CSV files with a header, each read by its own column names, united and aligned."""
    parts = [standardize_columns(spark.read.option("header", True).csv(p)) for p in paths]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part, allowMissingColumns=True)
    return align_schema(united)


def write_table(df: DataFrame, path: str, *partition_by: str, sort_by: Sequence[str] = ()) -> None:
    """Parquet, overwritten; sorted within files so that later scans can skip row groups."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_nested(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


SNAPSHOT = T.StructType([
    T.StructField("from", T.StringType()), T.StructField("to", T.StringType()),
    T.StructField("observations", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()), T.StructField("brightness", T.DoubleType()),
        T.StructField("frp", T.DoubleType()), T.StructField("date", T.StringType()), T.StructField("time", T.StringType()),
        T.StructField("satellite", T.StringType()),
    ]))),
])


def snapshot_documents(rows: DataFrame, day: str = "date", most: int = 10_000) -> DataFrame:
    """Snapshot documents of a day's rows: several per day, of at most about ``most`` observations, with a part number.

    A day is dealt into as many parts as it needs by a hash of the row, so no task or document holds a
    day.  The observation is the row's columns but ``day``.
    """
    observation = F.struct(*(c for c in rows.columns if c != day))
    sizes = rows.groupBy(day).agg(F.ceil(F.count("*") / (0.75 * most)).cast("int").alias("parts"))
    # One row per day, counted days: small, but not known beforehand.
    dealt = rows.select(F.col(day).alias("day"), observation.alias("o")).join(sizes.select(F.col(day).alias("day"), "parts").hint("merge"), "day")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("o"), F.col("parts")).cast("int"))
    documents = dealt.groupBy("day", "part").agg(F.collect_list("o").alias("observations"))
    text = F.col("day").cast("string")
    return documents.select(text.alias("from"), text.alias("to"), "part", "observations")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).json(path, multiLine=False)


def explode_snapshot(snapshot: DataFrame) -> DataFrame:
    """One row per observation, with the header's date range."""
    rows = snapshot.select(F.col("from").alias("from_date"), F.col("to").alias("to_date"), F.explode("observations").alias("o"))
    return rows.select("from_date", "to_date", "o.*")


def normalize_poi(raw: DataFrame) -> DataFrame:
    """Points from map elements: a node's own place, else its centre; rows without a place are dropped.

    ``raw`` has id, type, lat, lon, center (lat, lon), tags (map) and category.
    """
    lat, lon = F.coalesce("lat", "center.lat"), F.coalesce("lon", "center.lon")
    return raw.select(
        F.col("id").cast("long").alias("osm_id"), F.col("type").alias("osm_type"), lat.alias("latitude"),
        lon.alias("longitude"), "category", F.col("tags")["name"].alias("name"), F.col("tags")["landuse"].alias("landuse"), "tags",
    ).filter("latitude is not null and longitude is not null")
