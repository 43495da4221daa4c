"""Serving-side operators: lookups, tolerance joins, top lists, daily series, alerts, upserts, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detections as d
from .clean import keep_first
from ..sources.files import written
from .persistence import trailing
from .spatial import box_cells

#: Display labels of classes.
CLASS_LABELS = {
    "industrial_fire": "Industrial Fire", "gas_flare": "Gas Flare", "agricultural_burning": "Crop Burning", "wildfire": "Wildfire",
    "mining_thermal_source": "Mining thermal source",
}
PREDICTED_LABELS = CLASS_LABELS | {"agricultural_burning": "Agricultural Burning", "mining_thermal_source": "Mining Thermal Source"}


def normalize_feed(raw: DataFrame) -> DataFrame:
    """Provider rows as text to detections: first brightness at hand, serving confidence, finite places only."""
    number = lambda c: F.col(c).try_cast("double")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    out = raw.select(
        number("latitude").alias("latitude"), number("longitude").alias("longitude"),
        F.coalesce(number("bright_ti4"), number("bright_ti5"), F.lit(0.0)).alias("brightness"),
        d.confidence_code(F.col("confidence"), "serving").alias("confidence"), F.col("acq_date").cast("date").alias("acq_date"),
        F.lpad(F.col("acq_time").cast("string"), 4, "0").alias("acq_time"), "satellite", F.coalesce(number("frp"), F.lit(0.0)).alias("frp"),
    )
    return out.filter(finite("latitude") & finite("longitude"))


def match_unique(points: DataFrame, rows: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Points (id, latitude, longitude, date, time, satellite) with the one row at their place and time.

    Status is matched, ambiguous or unmatched.  Date, time, satellite and a small cell are join keys, so
    that one overpass is spread over many tasks; points go to each cell that their tolerance touches.
    """
    lat, lon, size = F.col("latitude"), F.col("longitude"), max(0.001, 10 * tolerance)
    keys = ["date", "time", "satellite", "_cell"]
    cell = F.struct(F.floor(lat / size).alias("a"), F.floor(lon / size).alias("b"))
    other = rows.withColumn("_cell", cell).select(*keys, lat.alias("y"), lon.alias("x"), "event_id", "fire_type")
    sent = points.withColumn("_cell", F.explode(box_cells(lat, lon, size, 2 * tolerance, 2 * tolerance)))
    near = (F.abs(F.col("latitude") - F.col("y")) < tolerance) & (F.abs(F.col("longitude") - F.col("x")) < tolerance)
    met = sent.join(other.hint("merge"), keys).filter(near).groupBy("id").agg(
        F.count("*").alias("matches"), F.min("event_id").alias("event_id"), F.min("fire_type").alias("fire_type")
    )
    out = points.select("id").join(met.hint("merge"), "id", "left")
    n = F.coalesce("matches", F.lit(0))
    one = n == 1
    return out.select(
        "id", F.when(one, "matched").when(n == 0, "unmatched").otherwise("ambiguous").alias("status"),
        F.when(one, F.col("event_id")).alias("event_id"), F.when(one, F.col("fire_type")).alias("fire_type"),
    )


def exactly_one(matched: DataFrame) -> DataFrame:
    """The same rows, or a failure when they are read if a point has no row or several."""
    one = F.col("status") == "matched"
    text = F.concat(F.lit("no single row for point "), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(": "), F.col("status"))
    return matched.withColumn("status", F.when(one, F.col("status")).otherwise(F.raise_error(text).cast("string")))


def match_outcomes(matched: DataFrame) -> DataFrame:
    outcome = F.when(F.col("status") == "matched", F.col("fire_type")).otherwise(F.col("status"))
    return matched.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def join_rounded(det: DataFrame, predictions: DataFrame) -> DataFrame:
    """Left join on places rounded to five decimals, date, time and satellite; several predictions fan out."""
    keyed = lambda df: df.withColumns({"lat_key": F.round("latitude", 5), "lon_key": F.round("longitude", 5)})
    keys = ["lat_key", "lon_key", "date", "time", "satellite"]
    return keyed(det).join(keyed(predictions).select(*keys, "predicted_fire_type").hint("merge"), keys, "left").drop("lat_key", "lon_key")


def display_type(firms_type: Column, predicted: Column) -> Column:
    """'Type n' from a raw number, raw text, the predicted label, or 'Unclassified'."""
    raw = F.trim(firms_type.cast("string"))
    known = F.create_map(*(F.lit(x) for pair in PREDICTED_LABELS.items() for x in pair))
    label = F.coalesce(known[predicted], F.initcap(F.replace(predicted, F.lit("_"), F.lit(" "))))
    number = F.floor(raw.try_cast("double")).cast("bigint")
    return (
        F.when(raw.isNotNull() & (raw != "") & number.isNotNull(), F.concat(F.lit("Type "), number))
        .when(raw.isNotNull() & (raw != ""), raw)
        .when(predicted.isNotNull() & (F.trim(predicted) != ""), F.concat(label, F.lit(" (predicted)")))
        .otherwise("Unclassified")
    )


def daily_series(det: DataFrame, days: int = 30) -> DataFrame:
    """One row per day of the window, zero where nothing was seen."""
    last = det.agg(F.max("date").alias("last_date"))
    calendar = last.select(F.explode(F.sequence(F.date_sub("last_date", days - 1), F.col("last_date"), F.expr("interval 1 day"))).alias("date"))
    sums = trailing(det, days).groupBy("date").agg(
        F.count("*").alias("detections"), F.sum("frp").alias("total_frp"), F.max("frp").alias("max_frp"), F.avg("frp").alias("mean_frp"),
        F.max("brightness").alias("max_brightness"), F.avg("brightness").alias("mean_brightness"),
    )
    out = calendar.join(sums.hint("shuffle_hash"), "date", "left")
    return out.select(
        "date", F.coalesce("detections", F.lit(0)).alias("detections"),
        *(F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("total_frp", "max_frp", "mean_frp", "max_brightness", "mean_brightness")),
    )


def daily_types(typed: DataFrame, days: int = 30) -> DataFrame:
    return trailing(typed, days).groupBy("date", "display_type").agg(F.count("*").alias("n"))


def type_totals(typed: DataFrame) -> DataFrame:
    return typed.groupBy("display_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "display_type")


#: Columns of an event that later rows of its key change.
CHANGING = ("brightness", "confidence", "risk", "classification", "source", "features")


def upsert_events(current: DataFrame, updates: DataFrame, key: str = "id", changing: tuple[str, ...] = CHANGING) -> DataFrame:
    """New rows are inserted whole; of known ones only the columns in ``changing`` change.

    Of several updates with one key the last by time counts, then the largest by its other columns.
    """
    order = sorted((c for c in updates.columns if c != key), key=lambda c: c != "detected_at")
    updates = keep_first(updates, [key], [F.desc(c) for c in order])
    ours, theirs = current.alias("c"), updates.alias("u")
    known = F.col(f"c.{key}").isNotNull()
    new = F.col(f"u.{key}").isNotNull()
    pick = [
        (F.when(new, F.col(f"u.{c}")).otherwise(F.col(f"c.{c}")) if c in changing else F.when(known, F.col(f"c.{c}")).otherwise(F.col(f"u.{c}"))).alias(c)
        for c in current.columns
        if c != key
    ]
    return ours.join(theirs, F.col(f"c.{key}") == F.col(f"u.{key}"), "full_outer").select(
        F.coalesce(f"c.{key}", f"u.{key}").alias(key), *pick
    )


def feed_events(feed: DataFrame) -> DataFrame:
    """Scored events from feed rows, one per id (the last by brightness)."""
    from .scoring import heuristic

    rows = feed.select(
        d.feed_id(F.col("acq_date"), F.col("acq_time"), F.col("latitude"), F.col("longitude")).alias("id"), "latitude", "longitude",
        d.observed_at(F.col("acq_date"), F.col("acq_time")).alias("detected_at"), "brightness", "confidence", F.lit(0.0).alias("persistence"),
        F.lit(10.0).alias("industrial_distance"), F.lit("unknown").alias("land_class"), "satellite", "frp",
    )
    scored = heuristic(rows)
    features = F.to_json(F.struct(F.col("confidence").alias("confidence"), "satellite", "frp"))
    events = scored.select(
        "id", "latitude", "longitude", "detected_at", "classification", F.col("class_confidence").alias("confidence"), "risk", "brightness",
        F.concat(F.lit("FEED_"), "satellite").alias("source"), features.alias("features"),
    )
    return keep_first(events, ["id"], [F.desc("brightness"), "features"])


def event_shape(events: DataFrame) -> DataFrame:
    """Served columns, from the JSON features where the row lacks them."""
    j = lambda p: F.get_json_object("features", f"$.{p}")
    return events.select(
        "id", F.coalesce(j("satellite"), F.lit("unknown")).alias("satellite"), F.coalesce(j("frp").try_cast("double"), F.lit(0.0)).alias("frp"),
        F.coalesce(j("persistenceDays").try_cast("int"), j("active_days_30d").try_cast("int"), F.lit(0)).alias("persistence_days"),
        "classification", "risk",
    )


def alert_sla(alerts: DataFrame, now: Column) -> DataFrame:
    """Queue of alerts (id, risk, status, created): age, state by risk, next status; unresolved first, newest first."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp("created")) / 60)
    warn = F.when(F.col("risk") == "CRITICAL", 5).when(F.col("risk") == "HIGH", 15).otherwise(30)
    state = F.when(F.col("status") == "resolved", "resolved").when(minutes >= 2 * warn, "breach").when(minutes >= warn, "warn").otherwise("ok")
    following = F.when(F.col("status") == "new", "ack").when(F.col("status") == "ack", "resolved").otherwise("new")
    out = alerts.select("id", "risk", "status", minutes.alias("age_minutes"), state.alias("sla"), following.alias("next_status"), "created")
    return out.orderBy(F.col("status") == "resolved", F.desc("created"), "id")


def kpis(events: DataFrame) -> DataFrame:
    yes = lambda c: F.sum(c.cast("int"))
    return events.agg(
        F.count("*").alias("events"), yes(F.col("risk").isin("HIGH", "CRITICAL")).alias("high_or_critical"),
        yes(F.col("persistence") >= 70).alias("persistent"), F.round(F.avg("confidence"), 4).alias("mean_confidence"),
    )


def priority(events: DataFrame) -> DataFrame:
    return events.filter((F.col("brightness") >= 340) | (F.coalesce("frp", F.lit(0.0)) >= 35) | F.col("tier").isin("HIGH", "CRITICAL"))


def search(events: DataFrame, text: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows whose joined columns contain a text, whatever its case."""
    return events.filter(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))


def numbered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Adds the row's place in a full order, without moving all rows to one task.

    Rows are range-partitioned and written; the sizes of the partitions before give a partition's first place.
    """
    rows = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "sorted")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # One row per partition.
    placed = rows.withColumn("_own", own).join(F.broadcast(sizes), "_part")
    return placed.withColumn(name, F.col("_first") + F.col("_own")).drop("_part", "_own", "_first")


def top_per_day(det: DataFrame, k: int = 200) -> DataFrame:
    """The ``k`` strongest rows of each day by power and brightness, with their number."""
    strength = F.coalesce("frp", F.lit(0.0)) + F.col("brightness") / 20
    w = Window.partitionBy("date").orderBy(F.desc(F.round("strength", 9)), "event_id")
    return det.withColumn("strength", strength).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def profile_nulls(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column_name, nulls) of the columns that hold nulls, from one pass."""
    counted = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns))
    return counted.select(F.explode(pairs).alias("p")).select("p.*").filter("nulls > 0")


def profile_value_counts(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column_name, value, n) of several low-cardinality columns, from one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column_name", "p.value").agg(F.count("*").alias("n"))


def key_set_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only."""
    a, b = left.select(key), right.select(key)
    only = lambda x, y, side: x.exceptAll(y).select(key, F.lit(side).alias("side"))
    return only(a, b, "left").unionByName(only(b, a, "right"))
