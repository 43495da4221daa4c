"""Registered queries: name -> (plan over Tables, output columns).

Output columns are 'name:kind' with kind l (long), d (double, six decimals), s (text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import detections as d
from ..functions import geo
from ..operators import clean, clusters, evidence, history, labels, model, persistence, scoring, serving, spatial
from ..sources import files
from ..streaming import ingest
from .tables import CLASSES, Tables

c, lit = F.col, F.lit
Plan = Callable[[Tables], DataFrame]
CATALOG: dict[str, tuple[Plan, str]] = {}


def query(columns: str) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        CATALOG[plan.__name__] = (plan, columns)
        return plan

    return add


def typed_column(spec: str) -> F.Column:
    name, kind = spec.split(":")
    if kind == "l":
        return c(name).cast("long").alias(name)
    if kind == "d":
        return (F.round(c(name).cast("double"), 6) + 0.0).alias(name)
    return c(name).cast("string").alias(name)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, columns = CATALOG[name]
    return plan(Tables(spark, sf_dir)).select(*map(typed_column, columns.split()))


def shared_tables(spark: SparkSession, sf_dir: str) -> None:
    """Writes the tables that several queries start from."""
    t = Tables(spark, sf_dir)
    for name in ("det", "feats", "distances", "members"):
        getattr(t, name)


# Sources, sinks and schemas


@query("source_id:l latitude:d longitude:d bright_ti4:d acq_time:l satellite:s product:s")
def scan_union_detections(t):
    """Archive and near-real-time parts written as CSV and read back as one table."""
    folder = files.shared_folder(t.spark, "scan")
    for part in ("ARCHIVE", "NRT"):
        t.raw.filter(c("product") == part).write.option("header", True).csv(f"{folder}/{part}")
    df = files.read_detections(t.spark, [f"{folder}/ARCHIVE", f"{folder}/NRT"])
    return df.withColumnsRenamed({"brightness": "bright_ti4", "time": "acq_time"})


@query("source_id:l brightness:d bright_t31:d date:s time:s frp:d firms_type:l confidence:s")
def scan_standardized(t):
    messy = t.raw.withColumnsRenamed({"bright_ti4": " Bright TI4 ", "acq_date": "ACQ_DATE", "type": "Type "}).drop("daynight")
    text = messy.withColumn("frp", F.when(c("source_id") % 7 == 0, "bad").otherwise(c("frp").cast("string")))
    return clean.standardized(text)


@query("latitude:d longitude:d brightness:d confidence:d acq_date:s acq_time:s satellite:s frp:d")
def feed_normalized(t):
    return t.feed


@query("event_id:s grid_id:l date:s brightness:d frp:d")
def sink_parquet_roundtrip(t):
    path = files.shared_folder(t.spark, "clean")
    month = t.det.withColumn("part_month", F.date_format("date", "yyyy-MM"))
    files.write_table(month, path, "part_month", sort_by=("grid_id", "date"))
    return t.spark.read.schema(month.schema).parquet(path)


@query("grid_id:l days:l observations:l peak:d")
def sink_json_roundtrip(t):
    days = history.daily_records(t.det)
    nested = days.groupBy("grid_id").agg(F.sort_array(F.collect_list(F.struct("date", "observation_count", "peak_brightness_k"))).alias("timeline"))
    path = files.shared_folder(t.spark, "records")
    files.write_nested(nested, path)
    back = t.spark.read.schema(nested.schema).json(path)
    total = F.aggregate("timeline", lit(0).cast("long"), lambda a, x: a + x["observation_count"])
    peak = F.array_max(F.transform("timeline", lambda x: x["peak_brightness_k"]))
    return back.select("grid_id", F.size("timeline").alias("days"), total.alias("observations"), peak.alias("peak"))


def _snapshot(t):
    rows = t.det
    o = F.struct(
        c("event_id").alias("id"), F.round("latitude", 5).alias("latitude"), F.round("longitude", 5).alias("longitude"), "brightness",
        "frp", c("date").cast("string").alias("date"), "time", "satellite",
    )
    return files.snapshot_documents(rows.select(c("date").alias("day"), o.alias("o")).select("day", "o.*"), "day", 500)


@query("id:s from_date:s latitude:d longitude:d brightness:d date:s time:s satellite:s")
def snapshot_explode(t):
    path = files.shared_folder(t.spark, "snapshot")
    files.write_nested(_snapshot(t), path)
    return files.explode_snapshot(files.read_snapshot(t.spark, path))


@query("osm_id:l osm_type:s latitude:d longitude:d category:s name:s landuse:s")
def poi_normalized(t):
    p = t.poi
    own = c("osm_id") % 3 != 0
    raw = p.select(
        c("osm_id").alias("id"), F.when(own, "node").otherwise("way").alias("type"), F.when(own, c("latitude")).alias("lat"),
        F.when(own, c("longitude")).alias("lon"),
        F.when(~own & (c("osm_id") % 9 != 0), F.struct(c("latitude").alias("lat"), c("longitude").alias("lon"))).alias("center"),
        F.map_filter(F.create_map(lit("name"), c("name"), lit("landuse"), c("landuse")), lambda k, v: v.isNotNull()).alias("tags"), "category",
    )
    return files.normalize_poi(raw)


def _updates(t):
    events = serving.feed_events(t.feed)
    n = F.conv(F.substring(F.md5(c("id").cast("binary")), 1, 4), 16, 10).cast("long")
    current = events.filter(n % 3 != 0)
    updates = events.filter(n % 2 == 0).withColumn("brightness", c("brightness") + 5).withColumn("latitude", c("latitude") + 1)
    return current, updates


@query("id:s latitude:d brightness:d confidence:d risk:s classification:s source:s")
def upsert_events(t):
    return serving.upsert_events(*_updates(t))


@query("column_name:s nulls:l")
def profile_nulls(t):
    return serving.profile_nulls(t.det, ("latitude", "brightness", "frp", "log_frp", "firms_type", "confidence_score"))


@query("column_name:s value:s n:l")
def profile_value_counts(t):
    return serving.profile_value_counts(t.det, ("satellite", "confidence_label", "daynight", "data_quality", "season", "firms_type"))


@query("rows:l cells:l cell_days:l persistent_cell_days:l high_persistence_cell_days:l persistent_detections:l high_persistence_detections:l first_time:s last_time:s")
def persistence_report(t):
    return persistence.report(t.feats)


# Projections


@query("source_id:l time:s seen_at:s")
def proj_timestamp(t):
    text = F.when(c("source_id") % 3 == 0, F.concat(c("acq_time"), lit(".0"))).when(c("source_id") % 17 == 0, "2561").otherwise(c("acq_time").cast("string"))
    time = d.hhmm(text)
    return t.raw.select("source_id", time.alias("time"), d.minute_text(d.observed_at(c("acq_date"), time)).alias("seen_at"))


@query("source_id:l training:d serving:d label:s")
def proj_confidence(t):
    text = F.when(c("source_id") % 5 == 0, F.upper("confidence")).when(c("source_id") % 9 == 0, "72").otherwise(c("confidence"))
    return t.raw.select("source_id", *(d.confidence_code(text, s).alias(s) for s in ("training", "serving", "label")))


@query("event_id:s log_frp:d thermal_excess:d")
def proj_thermal(t):
    return t.det


@query("event_id:s hour:l month:l day_of_year:l year:l is_weekend:l")
def proj_calendar(t):
    return t.det.withColumn("is_weekend", d.weekend(c("date")))


@query("event_id:s season:s")
def proj_season(t):
    return t.det


@query("event_id:s is_night:l product_by_date:s")
def proj_flags(t):
    return t.det.withColumn("product_by_date", d.product_by_cutoff(c("timestamp"), "2024-03-01"))


@query("source_id:l event_id:s feed_id:s")
def proj_event_id(t):
    return t.derived.withColumn("feed_id", d.feed_id(c("date"), c("time"), c("latitude"), c("longitude")))


@query("event_id:s grid_id:l grid_text:s small_cell:s")
def proj_grid(t):
    lat, lon = c("latitude"), c("longitude")
    return t.det.select("event_id", "grid_id", d.grid_text(lat, lon).alias("grid_text"), d.hundredth_cell(lat, lon).alias("small_cell"))


@query("event_id:s km:d km_history:d")
def proj_haversine(t):
    place = (c("latitude"), c("longitude"), lit(20.0), lit(80.0))
    return t.det.select("event_id", geo.haversine(*place).alias("km"), geo.haversine(*place, geo.HISTORY_RADIUS).alias("km_history"))


@query("event_id:s bearing:d compass:s ring:s")
def proj_bearing(t):
    place = (lit(20.0), lit(80.0), c("latitude"), c("longitude"))
    b = geo.bearing(*place)
    return t.det.select("event_id", b.alias("bearing"), geo.compass(b).alias("compass"), geo.ring(geo.haversine(*place) / 100).alias("ring"))


@query("event_id:s night_fire_flag:l persistent_activity:l high_frp_flag:l low_persistence_flag:l")
def proj_model_flags(t):
    return t.flagged


@query("event_id:s near_industrial_1km:l near_mining_2km:l near_gas_1km:l industrial_context_flag:l strong_industrial_context_flag:l")
def proximity_flags(t):
    n = F.length("event_id") % 5
    more = t.located.withColumns({
        "distance_to_power_plant_km": c("distance_to_gas_km") * 2, "distance_to_refinery_km": lit(None).cast("double"), "industrial_poi_count_5km": n,
    })
    return labels.industrial_context(more)


@query("source_id:l land_label:s land_class:s")
def proj_landcover(t):
    label = scoring.land_cover_label(((c("source_id") % 12) * 10).cast("int"))
    out = t.raw.select("source_id", label.alias("land_label"))
    return out.withColumn("land_class", scoring.land_cover_class(c("land_label")))


@query("event_id:s fire_type:s label_confidence:s")
def label_fire_type(t):
    return t.labelled


def _heuristic_input(t):
    cls = F.get(F.array(*map(lit, ("cropland", "forest", "mining", "unknown"))), (c("source_id") % 4).cast("int"))
    return t.det.select(
        "event_id", "brightness", d.confidence_code(c("confidence"), "serving").alias("confidence"), (c("source_id") % 100).cast("double").alias("persistence"),
        (c("source_id") % 7).cast("double").alias("industrial_distance"), cls.alias("land_class"),
    )


@query("event_id:s classification:s class_confidence:l risk:s c_industrial:d c_thermal:d c_persistence:d c_confidence:d")
def score_heuristic(t):
    return scoring.heuristic(_heuristic_input(t))


@query("event_id:s risk_score:d risk_level:s model_confidence:d frp_intensity:d persistence_component:d infrastructure:d")
def score_risk(t):
    return scoring.risk_score(t.located.withColumn("confidence", (c("source_id") % 101) / 100.0))


@query("event_id:s tier:s")
def score_tier(t):
    return t.det.select("event_id", d.tier(c("brightness"), c("frp")).alias("tier"))


@query("event_id:s evidence:s support_score:l conflicts:l support_level:s")
def geo_support(t):
    return scoring.geo_support(t.labelled)


@query("event_id:s violations:s")
def validate_observations(t):
    rows = t.feats.withColumns({
        "brightness": F.when(c("source_id") % 13 == 0, 150.0).otherwise(c("brightness")),
        "active_days_7d": F.when(c("source_id") % 17 == 0, 8).otherwise(c("active_days_7d")),
        "daynight": F.when(c("source_id") % 19 == 0, "X").otherwise(c("daynight")),
    })
    return scoring.validate(rows).select("event_id", F.array_join("violations", ",").alias("violations"))


@query("feature:s compared:l out_of_tolerance:l")
def feature_parity(t):
    return scoring.parity(t.feats.withColumn("log_frp", F.when(c("source_id") % 29 == 0, c("log_frp") + 0.001).otherwise(c("log_frp"))))


@query("event_id:s weight:d band:s")
def proj_density_band(t):
    return t.det.select("event_id", d.density_weight(c("brightness"), c("frp")).alias("weight"), d.thermal_band(c("brightness")).alias("band"))


@query("id:s satellite:s frp:d persistence_days:l classification:s risk:s")
def proj_event_shape(t):
    return serving.event_shape(serving.feed_events(t.feed))


@query("id:l risk:s status:s age_minutes:l sla:s next_status:s")
def alert_sla(t):
    at = c("ts").cast("timestamp")
    last = t.events.agg(F.max(at).alias("now"))
    pick = lambda names, n: F.get(F.array(*map(lit, names)), (c("event_id") % n).cast("int"))
    rows = t.events.filter("event_type = 'error'").select(
        c("event_id").alias("id"), pick(("CRITICAL", "HIGH", "MODERATE"), 3).alias("risk"), pick(("new", "ack", "resolved", "new"), 4).alias("status"),
        at.alias("created"),
    )
    return serving.alert_sla(rows.crossJoin(F.broadcast(last)), c("now"))


@query("event_id:s feature:s text:s")
def factor_text(t):
    return t.contributions.select("event_id", "feature", evidence.factor_text(c("feature"), c("value")).alias("text"))


@query("osm_id:l infra_category:s")
def poi_categories(t):
    n = c("osm_id")
    pairs = {
        "landuse": F.when(c("landuse") == "quarry", "quarry").when(n % 5 == 0, "industrial").when(n % 5 == 1, "landfill"),
        "power": F.when(n % 7 == 0, "plant"), "industrial": F.when(n % 11 == 0, "refinery"), "man_made": F.when(n % 13 == 0, "works").when(n % 13 == 1, "silo"),
    }
    flat = [x for k, v in pairs.items() for x in (lit(k), v)]
    return spatial.categories_of(t.poi.withColumn("tags", F.map_filter(F.create_map(*flat), lambda k, v: v.isNotNull())))


@query("event_id:s local_time:s")
def proj_local_time(t):
    return t.det.select("event_id", d.local_text(c("timestamp")).alias("local_time"))


# Filters


@query("source_id:l event_id:s seen_at:s")
def filter_region(t):
    return clean.in_region(t.derived, (10.0, 30.0, 70.0, 90.0)).withColumn("seen_at", d.minute_text(c("timestamp")))


@query("event_id:s date:s")
def filter_trailing_window(t):
    return persistence.trailing(t.det, 7)


@query("event_id:s date:s")
def filter_unlabelled(t):
    """Rows that a model still has to label."""
    return persistence.unlabelled(t.det)


@query("event_id:s tier:s")
def filter_priority_search(t):
    rows = t.det.withColumn("tier", d.tier(c("brightness"), c("frp")))
    return serving.search(serving.priority(rows), "n20", ("event_id", "satellite", "tier"))


@query("event_id:s")
def filter_complete_cases(t):
    return labels.complete_cases(t.flagged, ("brightness", "frp", "log_frp", "confidence_score", "persistence_score"))


# Joins


@query("event_id:s grid_id:l daily_total_frp:d daily_max_brightness:d hotspot_count_30d:l duplicate_keys:l")
def join_persistence_back(t):
    daily = persistence.prior_activity(persistence.daily_activity(t.det))
    twice = persistence.duplicate_keys(daily, ["grid_id", "date"]).agg(F.count("*").alias("duplicate_keys"))
    return t.det.join(daily, ["grid_id", "date"], "left").crossJoin(F.broadcast(twice))


@query("grid_id:l date:s wildfire_next_24h:l")
def join_next_day_label(t):
    return labels.next_day_label(persistence.daily_activity(t.det))


@query("latitude:d longitude:d distance_to_industrial_km:d distance_to_mining_km:d distance_to_gas_km:d")
def knn_distance(t):
    return t.distances


@query("id:l n:l")
def radius_count(t):
    return spatial.radius_count(t.cells.withColumnRenamed("grid_id", "id"), t.poi, 5.0)


@query("id:l right_category:s rank:l right_osm_id:l km:d")
def knn_top5(t):
    return spatial.top_nearest(t.cells.withColumnRenamed("grid_id", "id"), t.poi, 10.0, 5)


def _places(t):
    return t.poi.select(c("osm_id").alias("id"), "latitude", "longitude", (300 + c("osm_id") % 80).cast("double").alias("brightness"))


@query("id:l cluster_id:l match_method:s match_distance_km:d")
def resolve_cluster(t):
    return history.resolve_cluster(_places(t), t.cells)


def _points(t):
    """Snapshot points: some with another satellite, some rows doubled on the other side."""
    sat = F.when(c("source_id") % 21 == 0, F.when(c("satellite") == "N20", "N21").otherwise("N20")).otherwise(c("satellite"))
    lat = F.when(c("source_id") % 35 == 0, c("latitude") + 0.001).otherwise(F.round("latitude", 5))
    points = t.det.select(
        c("event_id").alias("id"), lat.alias("latitude"), F.round("longitude", 5).alias("longitude"), "date", "time", sat.alias("satellite")
    )
    rows = t.labelled.select("event_id", "latitude", "longitude", "date", "time", "satellite", "fire_type", "source_id")
    twice = rows.filter("source_id % 49 = 0").withColumn("event_id", F.concat("event_id", lit("#2")))
    return points, rows.unionByName(twice).drop("source_id")


@query("id:s status:s event_id:s fire_type:s")
def join_unique_tolerance(t):
    return serving.match_unique(*_points(t))


@query("outcome:s n:l")
def agg_match_outcomes(t):
    return serving.match_outcomes(serving.match_unique(*_points(t)))


@query("event_id:s predicted_fire_type:s")
def join_rounded_predictions(t):
    p = t.det.join(t.predicted.hint("merge"), "event_id")
    p = p.select("latitude", "longitude", "date", "time", "satellite", "predicted_fire_type", "source_id")
    twice = p.filter("source_id % 30 = 0").withColumn("predicted_fire_type", lit("wildfire"))
    return serving.join_rounded(t.det, p.unionByName(twice))


@query("grid_id:l event_id:s event_id2:s km:d hours:d")
def corroboration_pairs(t):
    return history.corroboration_pairs(t.det)


@query("id_a:s id_b:s km:d")
def event_edges(t):
    return clusters.event_edges(clusters.usable(t.clusterable))


@query("id:s observations:l unique_days:l score:l pattern:s")
def persistence_nearby(t):
    return persistence.nearby(t.det.select(c("event_id").alias("id"), "latitude", "longitude"), t.det)


@query("event_id:s display:s contact:s")
def join_lookup_default(t):
    rows = [(k, v, f"desk-{i}") for i, (k, v) in enumerate(serving.CLASS_LABELS.items()) if k != "wildfire"]
    table = t.spark.createDataFrame(rows, "predicted_fire_type string, display string, contact string")
    out = t.predicted.join(F.broadcast(table), "predicted_fire_type", "left")
    return out.fillna({"display": "Unclassified", "contact": "duty officer"})


@query("selected_id:s id:s km:d rank:l")
def nearest_events(t):
    rows = t.clusterable
    return clusters.nearest_events(rows, rows.orderBy("id").limit(1))


@query("id:l event_id:s brightness:d")
def strongest_in_box(t):
    return spatial.strongest_in_box(_places(t), t.det)


# Aggregations


@query("grid_id:l date:s daily_hotspots:l daily_total_frp:d daily_max_brightness:d daily_mean_confidence:d")
def agg_daily_activity(t):
    return persistence.daily_activity(t.det)


WIDE = (
    "grid_id:l date:s latitude:d longitude:d fire_count:l frp_sum:d frp_mean:d frp_max:d brightness_mean:d brightness_max:d "
    "confidence_mean:d confidence_max:d hotspot_count_7d:l active_days_7d:l hotspot_count_30d:l active_days_30d:l persistence_ratio_7d:d "
    "persistence_ratio_30d:d persistent_source_flag:l high_persistence_flag:l persistence_score:d daily_total_frp:d daily_max_brightness:d "
    "daily_mean_confidence:d year:l month:l day_of_year:l is_weekend:l"
)


@query(WIDE)
def agg_grid_day_wide(t):
    return labels.grid_day(t.feats)


@query("grid_id:l latitude:d longitude:d n:l")
def agg_cell_centroid(t):
    return t.cells


@query(
    "grid_id:l date:s observation_count:l peak_brightness_k:d mean_brightness_k:d peak_frp_mw:d mean_frp_mw:d satellites:s data_quality:s "
    "n_high:l n_low:l n_nominal:l dominant_confidence:s"
)
def hist_daily_records(t):
    r = history.daily_records(t.det)
    return r.withColumns({k: F.array_join(k, ",") for k in ("satellites", "data_quality")})


@query("grid_id:l date:s estimated_spread_km:d")
def hist_daily_spread(t):
    return history.daily_spread(t.det)


@query("event_id:s high_frp_flag:l")
def agg_high_frp(t):
    return t.flagged


@query("cell:s active_days:l observations:l score:l")
def agg_snapshot_persistence(t):
    return persistence.snapshot_persistence(t.det)


@query("date:s detections:l total_frp:d max_frp:d mean_frp:d max_brightness:d mean_brightness:d")
def agg_daily_analytics(t):
    return serving.daily_series(t.det)


@query("date:s display_type:s n:l")
def agg_daily_types(t):
    return serving.daily_types(t.typed)


@query("display_type:s n:l")
def agg_type_totals(t):
    return serving.type_totals(t.typed)


@query("fire_type:s high:l medium:l low:l")
def agg_crosstab(t):
    return labels.crosstab(t.labelled)


@query("event_id:s fire_type:s class_rank:l")
def sample_class_cap(t):
    return labels.class_capped(t.labelled, 15_000)


@query("grid_id:l date:s wildfire_next_24h:l")
def sample_balanced(t):
    return labels.balanced(labels.next_day_label(persistence.daily_activity(t.det)))


@query("events:l high_or_critical:l persistent:l mean_confidence:d")
def agg_kpis(t):
    return serving.kpis(t.served)


@query("component:s members:l classes:l mean_confidence:d south:d north:d west:d east:d")
def agg_cluster_summary(t):
    p = t.predicted.select(c("event_id").alias("id"), c("predicted_fire_type").alias("classification"), "confidence")
    return clusters.cluster_summary(t.members.join(p.hint("merge"), "id"))


def _evaluated(t):
    return t.labelled.filter("fire_type <> 'unknown'").join(t.predicted.hint("merge"), "event_id")


@query("actual:s predicted:s n:l")
def metrics_confusion(t):
    return model.confusion(_evaluated(t))


@query("name:s support:l precision:d recall:d f1:d")
def metrics_report(t):
    return model.metrics(_evaluated(t))


# Windows


@query("grid_id:l date:s hotspot_count_7d:l active_days_7d:l hotspot_count_30d:l active_days_30d:l")
def win_prior_activity(t):
    return persistence.prior_activity(persistence.daily_activity(t.det))


@query(
    "event_id:s grid_id:l date:s hotspot_count_7d:l active_days_7d:l hotspot_count_30d:l active_days_30d:l persistence_ratio_7d:d "
    "persistence_ratio_30d:d persistent_source_flag:l high_persistence_flag:l frp_per_detection_30d:d persistence_score:d"
)
def persistence_features(t):
    return persistence.features(t.det)


@query("event_id:s date:s rank:l strength:d")
def win_top_per_day(t):
    return serving.top_per_day(t.det, 200)


@query("event_id:s source_id:l grid_id:l data_quality:s brightness:d")
def dedup_near(t):
    return clean.dedup_near(t.det)


@query("event_id:s sign:l rank:l feature:s contribution:d")
def rank_factors(t):
    return evidence.rank_factors(t.contributions)


@query("event_id:s fire_type:s runner_up:s confidence:d gap_points:d close_call:l tentative:l")
def runner_up(t):
    return evidence.runner_up(t.predictions)


@query("event_id:s sign:l rank:l family:s magnitude:d factors:l text:s")
def evidence_groups(t):
    return evidence.evidence_groups(t.contributions)


@query("source_id:l event_id:s brightness:d data_quality:s")
def dedup_exact(t):
    return clean.dedup_exact(t.derived)


@query("event_id:s source_id:l brightness:d data_quality:s")
def dedup_event_id(t):
    return clean.dedup_event_id(t.derived)


# Sorts, limits, sets


@query("position:l event_id:s")
def sort_detections(t):
    order = ("timestamp", "latitude", "longitude", "event_id")
    return serving.numbered(t.det.select(*order), *order)


@query("event_id:s seen_at:s")
def topk_latest(t):
    return t.det.orderBy(F.desc("timestamp"), "event_id").limit(500).withColumn("seen_at", d.minute_text(c("timestamp")))


@query("event_id:s frp:d")
def topk_frp(t):
    rows = serving.priority(persistence.trailing(t.det, 30).withColumn("tier", d.tier(c("brightness"), c("frp"))))
    return rows.orderBy(F.desc_nulls_last("frp"), "event_id").limit(400)


@query("grid_id:l date:s observation_count:l peak_brightness_k:d confidence_text:s")
def last10_days(t):
    return history.last_days(t.det)


@query("event_id:s side:s")
def key_set_diff(t):
    return serving.key_set_diff(t.det.filter("source_id % 5 <> 0"), t.predicted.join(t.det.select("event_id", "source_id").hint("merge"), "event_id").filter("source_id % 7 <> 0"), "event_id")


# History


@query("grid_id:l centroid_latitude:d centroid_longitude:d total_observations:l satellites:s first_date:s last_date:s")
def hist_cluster_header(t):
    return history.header(t.det)


@query(
    "grid_id:l active_days:l total_observations:l current_streak_days:l longest_streak_days:l typical_recurrence_days:d trend_ratio:d "
    "recent_trend:s recurrence_index:l"
)
def hist_persistence(t):
    return history.persistence(t.det)


@query("grid_id:l observations_used:l status:s historical_median_k:d current_k:d deviation_ratio:d")
def hist_baseline(t):
    return history.baseline(t.det)


@query("grid_id:l label:s explanation:s")
def hist_behavior(t):
    return history.behavior(t.det)


@query("grid_id:l corroborated:l satellites:s satellite_count:l spatial_agreement_km:d temporal_separation_hours:d reason:s")
def hist_corroboration(t):
    return history.corroboration(t.det)


@query(
    "grid_id:l available:l persistence:s recurrence:s spatial_stability:s recent_trend:s observation_frequency:s day_night_behavior:s"
)
def hist_fingerprint(t):
    return history.fingerprint(t.det)


@query("grid_id:l status:s ratio:d comparison_window_start:s")
def hist_escalation(t):
    return history.escalation(t.det)


@query("grid_id:l status:s max_radius_km:d observations_used:l")
def hist_footprint(t):
    return history.footprint(t.det)


@query("grid_id:l total_observations:l days:l active_days:l baseline_status:s behavior_label:s corroborated:l fingerprint_available:l escalation_status:s footprint_status:s")
def hist_record(t):
    r = history.record(t.det)
    return r.select(
        "grid_id", "total_observations", F.size("timeline").alias("days"), c("persistence.active_days").alias("active_days"),
        c("baseline.status").alias("baseline_status"), c("behavior.label").alias("behavior_label"), c("corroboration.corroborated").alias("corroborated"),
        c("fingerprint.available").alias("fingerprint_available"), c("escalation.status").alias("escalation_status"),
        c("spatial_footprint.status").alias("footprint_status"),
    )


@query("id:l cluster_id:l match_method:s match_distance_km:d behavior:s baseline_status:s current_k:d deviation_ratio:d historical_median_k:d")
def enrich_history(t):
    return history.enrich(_places(t), t.det)


@query("cluster_id:s members:l latitude:d longitude:d radius_km:d time_span_hours:d")
def event_clusters(t):
    return clusters.described(t.members)


@query("cluster_id:s members:l position:l")
def clusters_by_size(t):
    sizes = t.members.groupBy(c("component").alias("cluster_id")).agg(F.count("*").alias("members"))
    return serving.numbered(sizes, F.desc("members"), "cluster_id")


# Models

MODEL_INPUTS = ("brightness", "frp", "log_frp", "confidence_score", "hour", "month", "active_days_30d", "hotspot_count_30d", "persistence_score")


@query("feature:s median:d missing:l")
def prep_impute_median(t):
    return model.medians(t.flagged, MODEL_INPUTS)


@query("feature:s constant:l")
def prep_drop_constant(t):
    return model.varying(t.flagged.withColumn("fixed", lit(1.0)), (*MODEL_INPUTS, "year", "fixed"))


@query("event_id:s fire_type:s part:s")
def split_stratified(t):
    return model.split_stratified(t.labelled.filter("fire_type <> 'unknown'"))


@query("name:s support:l precision:d recall:d f1:d")
def train_fire_type(t):
    parts = t.parts
    fitted = model.train(parts.filter("part = 'train'"), MODEL_INPUTS)
    return model.metrics(model.score(fitted, parts.filter("part = 'test'")))


@query("event_id:s predicted_fire_type:s confidence:d total:d")
def score_batch(t):
    parts = t.parts
    fitted = model.train(parts.filter("part = 'train'"), MODEL_INPUTS)
    total = F.aggregate(F.map_values("probabilities"), lit(0.0), lambda a, x: a + x)
    return model.score(fitted, parts.filter("part = 'test'")).withColumn("total", total)


@query("feature:s importance:d")
def feature_importance(t):
    return model.importance(model.train(t.parts, MODEL_INPUTS), MODEL_INPUTS)


@query("rows:l classes:l bad_sums:l bad_classes:l inputs:l importance:d")
def model_checks(t):
    """What holds for any forest on these rows: every test row gets a known class, and shares add up to one."""
    parts = t.parts
    fitted = model.train(parts.filter("part = 'train'"), MODEL_INPUTS)
    total = F.aggregate(F.map_values("probabilities"), lit(0.0), lambda a, x: a + x)
    scored = model.score(fitted, parts.filter("part = 'test'")).agg(
        F.count("*").alias("rows"), F.countDistinct("fire_type").alias("classes"), F.count(F.when(F.abs(total - 1) > 1e-6, 1)).alias("bad_sums"),
        F.count(F.when(~c("predicted_fire_type").isin(*CLASSES), 1)).alias("bad_classes"),
    )
    shares = model.importance(fitted, MODEL_INPUTS).agg(F.count("*").alias("inputs"), F.sum("importance").alias("importance"))
    return scored.crossJoin(F.broadcast(shares))


def _boosted(t):
    parts = t.parts
    return model.score_boosted(model.train_boosted(parts.filter("part = 'train'"), MODEL_INPUTS), parts.filter("part = 'test'"))


@query("name:s support:l precision:d recall:d f1:d")
def train_boosted(t):
    """Per-class and overall figures of boosted trees on the rows held out."""
    return model.metrics(_boosted(t))


@query("rows:l classes:l bad_sums:l bad_classes:l better:l")
def boosted_checks(t):
    """Every row held out gets a known class, shares add up to one, and the macro F1 is above that of the forest."""
    scored = files.written(_boosted(t), "boosted")
    total = F.aggregate(F.map_values("probabilities"), lit(0.0), lambda a, x: a + x)
    checks = scored.agg(
        F.count("*").alias("rows"), F.countDistinct("fire_type").alias("classes"), F.count(F.when(F.abs(total - 1) > 1e-6, 1)).alias("bad_sums"),
        F.count(F.when(~c("predicted_fire_type").isin(*CLASSES), 1)).alias("bad_classes"),
    )
    macro = lambda df: model.metrics(df).filter("name = '~macro'").select("f1")
    both = macro(scored).withColumnRenamed("f1", "ours").crossJoin(F.broadcast(train_fire_type(t).filter("name = '~macro'").select("f1")))
    # One row each.
    return checks.crossJoin(F.broadcast(both.select((c("ours") > c("f1")).cast("int").alias("better"))))


@query("feature_group:s features:l accuracy:d")
def group_ablation(t):
    return model.ablation(t.parts)


@query("feature:s rows:l missing:l")
def contract_check(t):
    """The features table passes the model's contract; rows and missing values of each input."""
    from ..schemas import FEATURES, require_contract

    table = require_contract(t.flagged)
    counts = table.agg(F.count("*").alias("rows"), *(F.count(F.when(c(f).isNull(), 1)).alias(f) for f in FEATURES))
    pairs = F.explode(F.array(*(F.struct(lit(f).alias("feature"), c(f).alias("missing")) for f in FEATURES)))
    return counts.select("rows", pairs.alias("p")).select("rows", "p.*")


@query("features:l high_frp_threshold:d confidence_scale:s")
def contract_table(t):
    from ..schemas import FEATURES

    table = labels.high_frp_threshold(t.det)
    return table.withColumns({"features": lit(len(FEATURES)), "confidence_scale": lit("0-100")})


@query("rows:l bad_sums:l bad_classes:l")
def check_predictions(t):
    pairs = F.map_from_entries(F.collect_list(F.struct("fire_type", "p"))).alias("probabilities")
    rows = t.predictions.groupBy("event_id").agg(pairs).join(t.predicted.hint("merge"), "event_id").withColumnRenamed("predicted_fire_type", "fire_type")
    return scoring.check_predictions(rows)


# Streams


def _as_files(t, df: DataFrame) -> tuple[str, T.StructType]:
    path = files.shared_folder(t.spark, "arriving")
    df.repartition(6, "acq_date").write.parquet(path) if "acq_date" in df.columns else df.repartition(6, "date").write.parquet(path)
    return path, df.schema


@query("id:s latitude:d brightness:d risk:s classification:s source:s")
def stream_upsert(t):
    path, schema = _as_files(t, t.feed)
    return ingest.stream_upsert(t.spark, path, schema, serving.feed_events, "id", serving.CHANGING)


@query("grid_id:l event_id:s brightness:d updates:l")
def stream_latest(t):
    """Each cell's latest detection, the last row of its update stream; at least one update per cell."""
    columns = t.det.select("grid_id", "timestamp", "brightness", "event_id", "date")
    path, schema = _as_files(t, columns)
    updates = ingest.stream_latest(t.spark, path, schema, "grid_id", ("timestamp", "brightness", "event_id", "date"), "timestamp", files=16)
    last = updates.groupBy("grid_id").agg(F.max_by(F.struct("event_id", "brightness"), "batch").alias("r"), F.count("*").alias("n"))
    return last.select("grid_id", "r.event_id", "r.brightness", (c("n") >= 1).cast("int").alias("updates"))


@query("event_id:s source_id:l brightness:d data_quality:s")
def stream_dedup(t):
    df = t.derived.select("event_id", "source_id", "brightness", "data_quality", "timestamp", "date")
    path, schema = _as_files(t, df)
    return ingest.stream_dedup(t.spark, path, schema, ["event_id", "source_id", "data_quality"], "timestamp", "400 days")


@query("grid_id:l date:s n:l max_brightness:d")
def stream_daily_activity(t):
    path, schema = _as_files(t, t.det.select("grid_id", "timestamp", "brightness", "date"))
    return ingest.stream_daily_activity(t.spark, path, schema, "400 days")
