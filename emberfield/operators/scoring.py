"""Heuristic and risk scores, land cover, geospatial support, validity rules, prediction checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detections import nearest_int, rounded

#: Land-cover classes by code.
LAND_COVER = {
    10: "Tree cover", 20: "Shrubland", 30: "Grassland", 40: "Cropland", 50: "Built-up", 60: "Bare / sparse vegetation",
    70: "Snow and ice", 80: "Permanent water bodies", 90: "Herbaceous wetland", 95: "Mangroves", 100: "Moss and lichen",
}


def land_cover_label(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LAND_COVER.items() for x in pair))
    return F.coalesce(table[code], F.lit("Unknown"))


def land_cover_class(label: Column) -> Column:
    has = lambda *words: F.lower(label).rlike("|".join(words))
    return (
        F.when(has("industrial"), "industrial").when(has("forest", "tree"), "forest").when(has("crop", "farm", "agri"), "cropland")
        .when(has("mine"), "mining").otherwise("unknown")
    )


def heuristic(df: DataFrame) -> DataFrame:
    """Class, confidence and risk from brightness, confidence, persistence, industrial_distance and land_class.

    Fixed values: base scores, bonuses and contributions.  Ties go to the class named first.
    """
    near, hot = F.col("industrial_distance") <= 2, F.col("brightness") >= 335
    steady, sure = F.col("persistence") >= 75, F.col("confidence") >= 80
    plus = lambda *cases: sum((F.when(c, v).otherwise(0.0) for c, v in cases), F.lit(0.0))
    cover = lambda c: F.col("land_class") == c
    scores = {
        "Industrial Fire": 0.2 + plus((near, 0.42), (hot, 0.12), (sure, 0.08)),
        "Gas Flare": 0.15 + plus((steady, 0.35)),
        "Crop Burning": 0.15 + plus((cover("cropland"), 0.42)),
        "Wildfire": 0.15 + plus((cover("forest"), 0.42)),
        "Mining": 0.15 + plus((cover("mining"), 0.42)),
    }
    ranked = [F.struct(F.round(s, 6).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores.items())]
    risk = F.col("brightness") * 0.7 + F.col("persistence") * 0.3
    return df.withColumn("_best", F.array_max(F.array(*ranked))).select(
        *df.columns,
        F.col("_best.n").alias("classification"), F.least(F.lit(99), nearest_int(F.round(55 + F.col("_best.s") * 40, 6))).alias("class_confidence"),
        F.when(risk >= 330, "CRITICAL").when(risk >= 305, "HIGH").when(risk >= 280, "MODERATE").otherwise("LOW").alias("risk"),
        F.when(near, 0.42).otherwise(-0.08).alias("c_industrial"), F.when(hot, 0.31).otherwise(0.12).alias("c_thermal"),
        F.when(steady, 0.24).otherwise(0.08).alias("c_persistence"), F.when(sure, 0.18).otherwise(0.05).alias("c_confidence"),
    )


def _clamped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))


def risk_score(df: DataFrame) -> DataFrame:
    """0-100 score and level from confidence (0-1), frp, persistence_score, persistent_activity and near flags."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    confidence, frp = z("confidence") * 100, _clamped(z("frp") / 300 * 100)
    persistence = _clamped(z("persistence_score") * 100)
    sites = z("near_gas_1km") * 20 + z("near_industrial_1km") * 20 + z("near_mining_2km") * 15
    score = rounded(_clamped(confidence * 0.30 + frp * 0.25 + persistence * 0.25 + sites * 0.15 + z("persistent_activity") * 5), 2)
    out = df.withColumn("risk_score", score)
    s = F.col("risk_score")
    return out.withColumns({
        "risk_level": F.when(s >= 75, "Critical").when(s >= 55, "High").when(s >= 30, "Moderate").otherwise("Low"),
        "model_confidence": rounded(confidence, 2), "frp_intensity": rounded(frp, 2), "persistence_component": rounded(persistence, 2),
        "infrastructure": F.round(sites, 2),
    })


def geo_support(df: DataFrame) -> DataFrame:
    """Evidence kinds near a point, and whether they support the predicted class; df has near flags and fire_type."""
    gas, industrial, mining = (F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("near_gas_1km", "near_industrial_1km", "near_mining_2km"))
    named = (("gas_infrastructure", gas), ("industrial_infrastructure", industrial), ("mining_activity", mining))
    kinds = F.array_compact(F.array(*(F.when(hit, F.lit(n)) for n, hit in named)))
    own = F.col("fire_type")
    natural = own.isin("wildfire", "agricultural_burning")
    needs = F.when(own == "gas_flare", gas).when(own == "industrial_fire", industrial).when(own == "mining_thermal_source", mining)
    n = F.size(kinds)
    reasons = F.when(natural, F.when(n == 0, 1).otherwise(0)).otherwise(F.coalesce(needs.cast("int"), F.lit(0)))
    conflicts = F.when(natural, n).otherwise(F.coalesce((~needs).cast("int"), F.lit(0)))
    return df.select(
        *df.columns, F.when(n == 0, "no_direct_proximity_evidence").otherwise(F.array_join(kinds, ",")).alias("evidence"),
        reasons.alias("support_score"), conflicts.alias("conflicts"),
        F.when(conflicts > 0, "conflict").when(reasons > 0, "supported").otherwise("neutral").alias("support_level"),
    )


def validate(df: DataFrame) -> DataFrame:
    """Adds ``violations``: names of the rules that an observation breaks, in the order of the rules."""
    c = F.col
    between = lambda n, lo, hi: c(n).isNull() | F.isnan(c(n).cast("double")) | ~c(n).between(lo, hi)
    whole = lambda n: c(n) != F.floor(c(n))
    a7, a30, n7, n30 = c("active_days_7d"), c("active_days_30d"), c("hotspot_count_7d"), c("hotspot_count_30d")
    rules = {
        "latitude": between("latitude", -90, 90), "longitude": between("longitude", -180, 180),
        "timestamp": c("timestamp").isNull(), "brightness": between("brightness", 200, 500),
        "bright_t31": between("bright_t31", 150, 400), "frp": between("frp", 0, 100000),
        "confidence_score": between("confidence_score", 0, 100), "daynight": c("daynight").isNull() | ~c("daynight").isin("D", "N"),
        "active_days_7d": between("active_days_7d", 0, 7) | whole("active_days_7d"),
        "active_days_30d": between("active_days_30d", 0, 30) | whole("active_days_30d"),
        "hotspot_count_7d": between("hotspot_count_7d", 0, 100000) | whole("hotspot_count_7d"),
        "hotspot_count_30d": between("hotspot_count_30d", 0, 100000) | whole("hotspot_count_30d"),
        "window_days": (a30 < a7) | (a30 > a7 + 23),
        "window_counts": (n7 < a7) | (n30 < a30) | (n30 < n7) | (n30 - n7 < a30 - a7),
        "window_zeros": ((a7 == 0) != (n7 == 0)) | ((a30 == a7) != (n30 == n7)),
        "daily_total_frp": between("daily_total_frp", 0, 10000000) | (c("daily_total_frp") < c("frp")),
        "daily_max_brightness": between("daily_max_brightness", 200, 500) | (c("daily_max_brightness") < c("brightness")),
        "daily_mean_confidence": between("daily_mean_confidence", 0, 100),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in rules.items())))
    return df.withColumn("violations", broken)


def recomputed(df: DataFrame) -> DataFrame:
    """Derived features from raw inputs, as ``re_*``."""
    a7, a30, n30 = F.col("active_days_7d"), F.col("active_days_30d"), F.col("hotspot_count_30d")
    return df.withColumns({
        "re_log_frp": F.log1p(F.greatest("frp", F.lit(0.0))), "re_thermal_excess": F.col("brightness") - 300,
        "re_persistence_ratio_30d": a30 / 30,
        "re_persistence_score": 0.5 * (a30 / 30) + 0.3 * F.least(n30 / 25, F.lit(1.0)) + 0.2 * (a7 / 7),
    })


def parity(df: DataFrame, atol: float = 2e-5, rtol: float = 2e-6) -> DataFrame:
    """Per feature: rows compared and rows out of tolerance."""
    names = ("log_frp", "thermal_excess", "persistence_ratio_30d", "persistence_score")
    rows = recomputed(df)
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("a"), F.col(f"re_{n}").alias("b")) for n in names)))
    long = rows.select(pairs.alias("p")).select("p.*").filter("a is not null and b is not null")
    off = F.abs(F.col("a") - F.col("b")) > atol + rtol * F.abs(F.col("b"))
    return long.groupBy("feature").agg(F.count("*").alias("compared"), F.sum(off.cast("int")).alias("out_of_tolerance"))


def check_predictions(predictions: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """One row: rows, rows whose probabilities don't sum to 1, rows whose class isn't the likeliest."""
    values = F.map_values("probabilities")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return predictions.agg(
        F.count("*").alias("rows"), F.sum((F.abs(total - 1) > tolerance).cast("int")).alias("bad_sums"),
        F.sum((F.col("probabilities")[F.col("fire_type")] < F.array_max(values)).cast("int")).alias("bad_classes"),
    )
