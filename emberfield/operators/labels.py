"""Proximity and activity flags, rule labels, and training tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detections as d
from .quantiles import exact_percentile


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def proximity_flags(df: DataFrame) -> DataFrame:
    """Near flags of the three categories; a missing distance is not near."""
    gas, industrial, mining = (F.col(f"distance_to_{c}_km") for c in ("gas", "industrial", "mining"))
    return df.withColumns(
        {"near_industrial_1km": _flag(industrial <= 1), "near_mining_2km": _flag(mining <= 2), "near_gas_1km": _flag(gas <= 1)}
    )


def industrial_context(df: DataFrame) -> DataFrame:
    """Context flags from distances to industry, power plants and refineries and the number of sites in 5 km."""
    near = lambda km: [_flag(F.col(f"distance_to_{c}_km") <= km) for c in ("industrial", "power_plant", "refinery")]
    return df.withColumns({
        "industrial_context_flag": F.greatest(*near(5), _flag(F.col("industrial_poi_count_5km") >= 3)),
        "strong_industrial_context_flag": F.greatest(*near(2)),
    })


def high_frp_threshold(df: DataFrame, share: float = 0.9, approximate: int | None = None) -> DataFrame:
    """One row with the percentile of radiative power, linearly interpolated; or a bounded sketch of it."""
    if approximate is None:
        exact = exact_percentile(df.select(F.lit("frp").alias("feature"), F.col("frp").alias("value")), share)
        return exact.agg(F.max("percentile").alias("high_frp_threshold"))
    return df.agg(F.percentile_approx("frp", share, approximate).alias("high_frp_threshold"))


def model_flags(df: DataFrame, threshold: DataFrame) -> DataFrame:
    """Night, persistent activity, high power and low persistence; the threshold is one row."""
    df = df.crossJoin(F.broadcast(threshold))
    return df.withColumns({
        "night_fire_flag": F.col("is_night"),
        "persistent_activity": _flag((F.col("active_days_7d") >= 3) | (F.col("active_days_30d") >= 10)),
        "high_frp_flag": _flag(F.col("frp") >= F.col("high_frp_threshold")),
        "low_persistence_flag": _flag(F.col("active_days_30d") <= 2),
    }).drop("high_frp_threshold")


def label_fire_type(df: DataFrame) -> DataFrame:
    """First rule that holds: gas, mining, industrial, agricultural, wildfire; else unknown.

    A missing distance does not count as far, so it cannot make a wildfire.
    """
    active = F.col("persistent_activity") == 1
    far = (
        (F.col("distance_to_industrial_km") > 2) & (F.col("distance_to_mining_km") > 2) & (F.col("distance_to_gas_km") > 2)
    )
    kind = (
        F.when((F.col("near_gas_1km") == 1) & (F.col("active_days_30d") >= 5), "gas_flare")
        .when((F.col("near_mining_2km") == 1) & active, "mining_thermal_source")
        .when((F.col("near_industrial_1km") == 1) & active, "industrial_fire")
        .when((F.col("low_persistence_flag") == 1) & F.col("month").isin(3, 4, 5, 10, 11), "agricultural_burning")
        .when(active & far, "wildfire")
        .otherwise("unknown")
    )
    quality = (
        F.when(F.col("fire_type").isin("gas_flare", "mining_thermal_source"), "high")
        .when(F.col("fire_type") == "unknown", "low")
        .otherwise("medium")
    )
    return df.withColumn("fire_type", kind).withColumn("label_confidence", quality)


def grid_day(feats: DataFrame) -> DataFrame:
    """One row per cell and day with the measures of its detections and of its history."""
    mean = {"latitude": "latitude", "longitude": "longitude", "frp_mean": "frp", "brightness_mean": "brightness", "confidence_mean": "confidence_score"}
    top = {"frp_max": "frp", "brightness_max": "brightness", "confidence_max": "confidence_score"}
    history = (
        "hotspot_count_7d", "active_days_7d", "hotspot_count_30d", "active_days_30d", "persistence_ratio_7d",
        "persistence_ratio_30d", "persistent_source_flag", "high_persistence_flag", "persistence_score", "daily_total_frp",
        "daily_max_brightness", "daily_mean_confidence",
    )
    out = feats.groupBy("grid_id", "date").agg(
        F.count("event_id").alias("fire_count"), F.sum("frp").alias("frp_sum"),
        *(F.avg(c).alias(n) for n, c in mean.items()), *(F.max(c).alias(n) for n, c in top.items()),
        *(F.max(c).alias(c) for c in history),
    )
    return out.withColumns({
        "year": F.year("date"), "month": F.month("date"), "day_of_year": F.dayofyear("date"), "is_weekend": d.weekend(F.col("date")),
    })


def next_day_label(daily: DataFrame) -> DataFrame:
    """Whether the same cell is active on the next day.  The window is partitioned as the cell-day rows are."""
    following = F.lead("date").over(Window.partitionBy("grid_id").orderBy("date"))
    return daily.withColumn("wildfire_next_24h", _flag(following == F.date_add("date", 1)))


def centroid(det: DataFrame) -> DataFrame:
    return det.groupBy("grid_id").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.count("*").alias("n")
    )


def crosstab(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("fire_type").pivot("label_confidence", ["high", "medium", "low"]).agg(F.count(F.lit(1))).fillna(0)


def hashed(key: Column) -> Column:
    """A fixed shuffling order of rows."""
    return F.md5(key.cast("string").cast("binary"))


def hash_rank(df: DataFrame, group: str, key: Column, name: str = "hash_rank") -> DataFrame:
    """Adds the rank of each row within its group by the hash of its key.

    A group may hold most rows: ranks are taken within 4096 ranges of the hash, and the sizes of the
    ranges before are added, so no task gets a whole group.
    """
    rows = df.withColumns({"_h": hashed(key), "_key": key.cast("string")}).withColumn("_range", F.substring("_h", 1, 3))
    sizes = rows.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy(group, "_range").orderBy("_h", "_key")
    ranked = rows.withColumn("_own", F.row_number().over(own)).join(firsts.hint("shuffle_hash"), [group, "_range"])
    return ranked.withColumn(name, F.col("_first") + F.col("_own")).drop("_h", "_key", "_range", "_first", "_own")


def class_capped(labelled: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` rows per class in a fixed random order, without low-confidence unknowns.

    Ranks are taken within ranges of the hash, so no task sorts a whole class.
    """
    usable = labelled.filter(~((F.col("fire_type") == "unknown") & (F.col("label_confidence") == "low")))
    return hash_rank(usable, "fire_type", F.col("event_id"), "class_rank").filter(F.col("class_rank") <= cap)


def balanced(daily: DataFrame, ratio: int = 2) -> DataFrame:
    """All positive cell-days and at most ``ratio`` times as many negative ones, in a fixed random order."""
    limit = daily.agg((F.sum("wildfire_next_24h") * ratio).alias("limit"))
    ranked = hash_rank(daily.filter("wildfire_next_24h = 0"), "wildfire_next_24h", F.concat_ws(":", "grid_id", "date"), "n")
    kept = ranked.crossJoin(F.broadcast(limit)).filter("n <= limit").select(*daily.columns)
    return daily.filter("wildfire_next_24h = 1").unionByName(kept)


def complete_cases(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Rows whose inputs are all there and finite."""
    bad = lambda c: F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf"))
    df = df.dropna(subset=list(features))
    for f in features:
        df = df.filter(~bad(f))
    return df
