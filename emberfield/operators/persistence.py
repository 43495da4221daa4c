"""Prior-window persistence per grid cell and day, without looking at the day itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detections as d
from .spatial import bucket_join


def daily_activity(det: DataFrame) -> DataFrame:
    return det.groupBy("grid_id", "date").agg(
        F.count("*").alias("daily_hotspots"), F.sum("frp").alias("daily_total_frp"),
        F.max("brightness").alias("daily_max_brightness"), F.avg("confidence_score").alias("daily_mean_confidence"),
    )


def prior_activity(daily: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Detections and active days of the calendar days [d - n, d - 1] of the same cell."""
    daily = daily.withColumn("day_no", F.datediff("date", F.lit("1970-01-01").cast("date")))
    for n in windows:
        w = Window.partitionBy("grid_id").orderBy("day_no").rangeBetween(-n, -1)
        daily = daily.withColumn(f"hotspot_count_{n}d", F.coalesce(F.sum("daily_hotspots").over(w), F.lit(0)))
        daily = daily.withColumn(f"active_days_{n}d", F.count("*").over(w))
    return daily.drop("day_no")


def scored(prior: DataFrame) -> DataFrame:
    """Ratios, flags and score from the prior windows."""
    a7, a30, n30 = (F.col(c) for c in ("active_days_7d", "active_days_30d", "hotspot_count_30d"))
    ratio = a30 / 30
    score = 0.5 * ratio + 0.3 * F.least(n30 / 25, F.lit(1.0)) + 0.2 * F.least(a7 / 7, F.lit(1.0))
    return prior.select(
        "*",
        (a7 / 7).alias("persistence_ratio_7d"), ratio.alias("persistence_ratio_30d"),
        ((a30 >= 5) | (n30 >= 10)).cast("int").alias("persistent_source_flag"),
        ((a30 >= 10) | (n30 >= 25)).cast("int").alias("high_persistence_flag"),
        F.when(n30 > 0, F.coalesce("daily_total_frp", F.lit(0.0)) / n30).otherwise(0.0).alias("frp_per_detection_30d"),
        F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("persistence_score"),
    )


def features(det: DataFrame) -> DataFrame:
    """Detections with the persistence of their cell and day.

    Both sides are hashed by cell, so the join reuses the partitioning of the windows.
    """
    daily = scored(prior_activity(daily_activity(det)))
    return det.join(daily, ["grid_id", "date"], "left")


def duplicate_keys(right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: empty where a many-to-one join is safe."""
    return right.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def report(feats: DataFrame) -> DataFrame:
    cell_day = F.struct("grid_id", "date")
    return feats.agg(
        F.count("*").alias("rows"), F.countDistinct("grid_id").alias("cells"),
        F.countDistinct(cell_day).alias("cell_days"),
        F.countDistinct(F.when(F.col("persistent_source_flag") == 1, cell_day)).alias("persistent_cell_days"),
        F.countDistinct(F.when(F.col("high_persistence_flag") == 1, cell_day)).alias("high_persistence_cell_days"),
        F.sum("persistent_source_flag").alias("persistent_detections"),
        F.sum("high_persistence_flag").alias("high_persistence_detections"),
        d.minute_text(F.min("timestamp")).alias("first_time"), d.minute_text(F.max("timestamp")).alias("last_time"),
    )


def nearby(current: DataFrame, history: DataFrame, km: float = 0.75, days: int = 30) -> DataFrame:
    """Per current point (id): observations and unique days of the history within ``km``, score and pattern.

    Places are compared, each once; a place's history is its number of observations by day.
    """
    place = ["latitude", "longitude"]
    days_of = history.groupBy(*place, "date").agg(F.count("*").alias("n"))
    near = bucket_join(current.select(*place).distinct(), history.select(*place).distinct(), km)
    near = near.select(*place, F.col("right_latitude").alias("y"), F.col("right_longitude").alias("x"))
    seen = near.join(days_of.select(F.col("latitude").alias("y"), F.col("longitude").alias("x"), "date", "n").hint("merge"), ["y", "x"])
    seen = seen.groupBy(*place, "date").agg(F.sum("n").alias("n"))
    seen = seen.groupBy(*place).agg(F.sum("n").alias("observations"), F.count("date").alias("unique_days"))
    both = current.select("id", *place).join(seen.hint("merge"), place, "left").fillna(0, ["observations", "unique_days"]).drop(*place)
    enough = F.col("unique_days") >= 2
    score = F.when(enough, F.least(F.lit(100), d.nearest_int(F.col("unique_days") / days * 100))).otherwise(F.lit(0))
    return both.withColumn("score", score.cast("long")).withColumn(
        "pattern",
        F.when(~enough, "INSUFFICIENT_HISTORY").when(F.col("score") >= 55, "PERSISTENT").otherwise("TRANSIENT"),
    )


def snapshot_persistence(det: DataFrame, days: int = 30) -> DataFrame:
    """Distinct active days and observations per hundredth-degree cell of the last ``days`` days."""
    cell = d.hundredth_cell(F.col("latitude"), F.col("longitude"))
    grouped = trailing(det, days).groupBy(cell.alias("cell")).agg(
        F.countDistinct("date").alias("active_days"), F.count("*").alias("observations")
    )
    return grouped.withColumn("score", d.nearest_int(F.col("active_days") / days * 100))


def unlabelled(det: DataFrame, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` days whose type is still unknown."""
    return trailing(det, days).filter("firms_type is null")


def trailing(det: DataFrame, days: int) -> DataFrame:
    """Rows of the last ``days`` calendar days up to the data's own last day."""
    last = det.agg(F.max("date").alias("last_date"))
    return det.crossJoin(F.broadcast(last)).filter(F.col("date") > F.date_sub("last_date", days)).drop("last_date")


