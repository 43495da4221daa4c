"""Detections, infrastructure points and derived tables made from the driver's tables.

The same SQL text runs on Spark and on the oracle's engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS_TO_DETECTIONS = """
WITH base AS (
 SELECT event_id, user_id, event_type, value, ts + INTERVAL '46' DAY AS ts FROM events
), raw AS (
 SELECT event_id, user_id, event_type, value, ts, 0 AS echo FROM base
 UNION ALL SELECT event_id, user_id, event_type, value, ts, 0 AS echo FROM base WHERE event_id % 50 = 0
 UNION ALL SELECT event_id, user_id, event_type, value, ts + INTERVAL '4' MINUTE AS ts, 1 AS echo FROM base WHERE event_id % 11 = 0
), geo AS (
 SELECT event_id, event_type, value, echo, ts,
  CASE WHEN event_id % 5 = 0 OR user_id % 3 = 1 AND event_id % 4 <> 0
       THEN 8.0031E0 + (event_id * 7919 % 2900) / 100.0E0
       ELSE 8.0031E0 + (user_id * 37 % 290) / 10.0E0 + (event_id % 40) / 1000.0E0 END AS latitude,
  CASE WHEN event_id % 5 = 0 OR user_id % 3 = 1 AND event_id % 4 <> 0
       THEN 68.0031E0 + (event_id * 104729 % 2800) / 100.0E0
       ELSE 68.0031E0 + (user_id * 53 % 280) / 10.0E0 + (event_id * 7 % 40) / 1000.0E0 END AS longitude
 FROM raw)
SELECT event_id AS source_id, latitude, longitude,
  295.0E0 + LEAST(value, 240.0E0) * 0.6E0 + echo * 2.0E0 AS bright_ti4,
  280.0E0 + (event_id % 30) AS bright_ti5,
  CAST(ts AS DATE) AS acq_date,
  hour(ts) * 100 + minute(ts) AS acq_time,
  CASE WHEN event_id % 2 = 0 THEN 'N20' ELSE 'N21' END AS satellite,
  CASE event_type WHEN 'click' THEN 'n' WHEN 'view' THEN 'nominal' WHEN 'signup' THEN 'l' WHEN 'purchase' THEN 'h' ELSE 'low' END AS confidence,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN NULL ELSE value / 3.0E0 END AS frp,
  CASE WHEN hour(ts) < 6 OR hour(ts) >= 18 THEN 'N' ELSE 'D' END AS daynight,
  CASE WHEN event_id % 2 = 0 THEN event_id % 4 END AS type,
  CASE WHEN echo = 1 OR ts >= TIMESTAMP '2024-03-08 00:00:00' THEN 'NRT' ELSE 'ARCHIVE' END AS product
FROM geo
"""

CUSTOMERS_TO_POINTS = """
SELECT c_custkey AS osm_id, 'node' AS osm_type,
  8.0031E0 + (c_custkey * 37 % 290) / 10.0E0 + (c_custkey % 7) / 250.0E0 AS latitude,
  68.0031E0 + (c_custkey * 53 % 280) / 10.0E0 + (c_custkey % 5) / 250.0E0 AS longitude,
  CASE c_custkey % 3 WHEN 0 THEN 'industrial' WHEN 1 THEN 'gas' ELSE 'mining' END AS category,
  CASE WHEN c_custkey % 6 = 5 THEN 'quarry' END AS landuse,
  CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name
FROM customer WHERE c_custkey % 4 <> 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def detections_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = EVENTS_TO_DETECTIONS.replace("FROM events", "FROM {events}")
    return spark.sql(sql, events=table(spark, sf_dir, "events"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = CUSTOMERS_TO_POINTS.replace("FROM customer", "FROM {customer}")
    return spark.sql(sql, customer=table(spark, sf_dir, "customer"))
