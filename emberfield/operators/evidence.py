"""Ranking and grouping of factor contributions, and their wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Wording of yes/no factors (no, yes) and of measured ones.
FLAGS = {
    "persistent_activity": ("Activity recorded on fewer than 3 of 7 days and fewer than 10 of 30 days", "Activity recorded on at least 3 of 7 days or 10 of 30 days"),
    "persistent_source_flag": ("Fewer than 5 active days and 10 detections in 30 days", "At least 5 active days or 10 detections in 30 days"),
    "high_persistence_flag": ("Fewer than 10 active days and 25 detections in 30 days", "At least 10 active days or 25 detections in 30 days"),
    "low_persistence_flag": ("Activity recorded on more than 2 of 30 days", "Activity recorded on no more than 2 of 30 days"),
    "high_frp_flag": ("Radiative power is below the model’s high-power cutoff", "Radiative power reaches the model’s high-power cutoff"),
    "is_night": ("Satellite passed during daytime", "Satellite passed at night"),
    "night_fire_flag": ("Satellite passed during daytime", "Satellite passed at night"),
}
MEASURES = {
    "brightness": "Satellite brightness temperature: {} K", "bright_t31": "Secondary-band brightness temperature: {} K",
    "frp": "Radiative power: {} MW", "daily_total_frp": "Daily total radiative power: {} MW",
    "daily_max_brightness": "Daily peak brightness temperature: {} K", "daily_mean_confidence": "Daily mean detection confidence: {}%",
    "confidence_score": "Satellite detection confidence: {}%", "frp_per_detection_30d": "Radiative power per historical detection: {} MW",
    "persistence_score": "Combined recurrence indicator: {}", "log_frp": "Radiative power on the model’s logarithmic scale: {}",
    "hour": "Observation hour: {}:00 UTC", "month": "Observation month: {}", "day_of_year": "Observation falls on day {} of the year",
    "active_days_7d": "Detected on {} of the previous 7 days", "active_days_30d": "Detected on {} of the previous 30 days",
    "hotspot_count_7d": "{} detections in the previous 7 days", "hotspot_count_30d": "{} detections in the previous 30 days",
}


def short(x: Column, digits: int = 2) -> Column:
    """A number with at most so many decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x), "0+$", ""), r"\.$", "")


def factor_text(feature: Column, value: Column) -> Column:
    spoken = F.regexp_replace(feature, "_", " ")
    capital = F.concat(F.upper(F.substring(spoken, 1, 1)), F.expr("substring(replace(feature, '_', ' '), 2)"), F.lit(": "), short(value))
    text = F.when(value.isNull() | F.isnan(value), F.concat(spoken, F.lit(": value unavailable")))
    for name, (no, yes) in FLAGS.items():
        text = text.when((feature == name) & (value == 0), no).when((feature == name) & (value == 1), yes)
    for name, pattern in MEASURES.items():
        before, after = pattern.split("{}")
        text = text.when(feature == name, F.concat(F.lit(before), short(value), F.lit(after)))
    side = F.when(value < 0, "below").otherwise("above")
    excess = F.concat(F.lit("Brightness temperature is "), short(F.abs(value)), F.lit(" K "), side, F.lit(" the 300 K reference"))
    text = text.when(feature == "thermal_excess", excess)
    for n in (7, 30):
        share = F.concat(F.lit("Activity recorded on "), short(value * 100, 1), F.lit(f"% of the previous {n} days"))
        text = text.when(feature == f"persistence_ratio_{n}d", share)
    return text.otherwise(capital)


def family(feature: Column) -> Column:
    recurrence = feature.rlike("^(active_days_|hotspot_count_|persistence_|persistent_|high_persistence|low_persistence)")
    return (
        F.when(recurrence, "recurrence").when(feature.isin("frp", "log_frp", "high_frp_flag"), "power")
        .when(feature.isin("is_night", "night_fire_flag", "hour"), "time").when(feature.isin("month", "day_of_year"), "season").otherwise(feature)
    )


def rank_factors(contributions: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` largest contributions of either sign per event; ties by feature."""
    rows = contributions.filter("contribution <> 0").withColumn("sign", F.signum("contribution").cast("int"))
    w = Window.partitionBy("event_id", "sign").orderBy(F.desc(F.abs("contribution")), "feature")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def evidence_groups(contributions: DataFrame, k: int = 2) -> DataFrame:
    """Factor families per event and sign: summed magnitude, number, and the text of their leading facts.

    Recurrence shows two facts and prefers active days; the others show one.  The ``k`` largest stay.
    """
    rows = contributions.filter("contribution <> 0 and not isnan(contribution)").withColumns({
        "sign": F.signum("contribution").cast("int"), "family": family(F.col("feature")), "text": factor_text(F.col("feature"), F.col("value")),
    })
    direct = F.col("feature").startswith("active_days_").cast("int")
    fact = F.struct((-F.abs("contribution")).alias("m"), F.col("feature").alias("feature"), F.col("text").alias("text"))
    grouped = rows.withColumn("direct", direct).groupBy("event_id", "sign", "family").agg(
        F.sum(F.abs("contribution")).alias("magnitude"), F.count("*").alias("factors"),
        F.sort_array(F.collect_list(fact)).alias("all"), F.sort_array(F.collect_list(F.when(F.col("direct") == 1, fact))).alias("days"),
    )
    recurrent = F.col("family") == "recurrence"
    facts = F.when(recurrent & (F.size("days") > 0), F.slice("days", 1, 2)).when(recurrent, F.slice("all", 1, 2)).otherwise(F.slice("all", 1, 1))
    w = Window.partitionBy("event_id", "sign").orderBy(F.desc(F.round("magnitude", 9)), "family")
    ranked = grouped.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select(
        "event_id", "sign", "rank", "family", F.round("magnitude", 6).alias("magnitude"), "factors",
        F.array_join(F.transform(facts, lambda f: f["text"]), "; ").alias("text"),
    )


def runner_up(probabilities: DataFrame) -> DataFrame:
    """Best and second class per event, gap in points, close call and tentative flags; rows (event_id, fire_type, p)."""
    w = Window.partitionBy("event_id").orderBy(F.desc("p"), "fire_type")
    ranked = probabilities.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    out = ranked.groupBy("event_id").agg(
        F.max(F.when(F.col("r") == 1, F.col("fire_type"))).alias("fire_type"), F.max(F.when(F.col("r") == 1, F.col("p"))).alias("p1"),
        F.max(F.when(F.col("r") == 2, F.col("fire_type"))).alias("runner_up"), F.max(F.when(F.col("r") == 2, F.col("p"))).alias("p2"),
    )
    gap = F.round((F.col("p1") - F.col("p2")) * 100, 4)
    close = F.coalesce((gap >= 0) & (gap < 10), F.lit(False))
    return out.select(
        "event_id", "fire_type", "runner_up", F.round("p1", 6).alias("confidence"), gap.alias("gap_points"), close.cast("int").alias("close_call"),
        ((F.col("p1") < 0.5) | close).cast("int").alias("tentative"),
    )
