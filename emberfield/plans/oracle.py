"""SQL for the registered queries, to be run by another engine on the same tables."""

from __future__ import annotations

from ..functions.geo import HISTORY_RADIUS, RADIUS
from ..operators.evidence import FLAGS, MEASURES
from ..operators.scoring import LAND_COVER
from ..operators.serving import CLASS_LABELS, PREDICTED_LABELS
from ..sources.fixtures import CUSTOMERS_TO_POINTS, EVENTS_TO_DETECTIONS
from ..schemas import FEATURES
from .catalog import CATALOG, MODEL_INPUTS
from .tables import CLASSES, EXPLAINED


def hv(a: str, b: str, x: str, y: str, r: float = RADIUS) -> str:
    """Distance between (a, b) and (x, y), both latitude and longitude."""
    return (
        f"2*{r}E0*asin(least(1.0E0, sqrt(pow(sin((radians({x})-radians({a}))/2),2)"
        f"+cos(radians({a}))*cos(radians({x}))*pow(sin((radians({y})-radians({b}))/2),2))))"
    )


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cases(column: str, table: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k if isinstance(k, int) else q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def up(x: str) -> str:
    return f"CAST(floor({x} + 0.5E0) AS BIGINT)"


CLASS_LIST = "[" + ",".join(map(q, CLASSES)) + "]"
TRAINING = "CASE WHEN lower({0}) IN ('l','low') THEN 0.0E0 WHEN lower({0}) IN ('n','nominal') THEN 50.0E0 WHEN lower({0}) IN ('h','high') THEN 100.0E0 END"
SERVING = "coalesce(CASE WHEN lower({0}) IN ('l','low') THEN 30.0E0 WHEN lower({0}) IN ('n','nominal') THEN 60.0E0 WHEN lower({0}) IN ('h','high') THEN 90.0E0 END, TRY_CAST({0} AS DOUBLE), 0.0E0)"
LEVEL = "CASE WHEN lower({0}) IN ('l','low') THEN 'low' WHEN lower({0}) IN ('n','nominal') THEN 'nominal' WHEN lower({0}) IN ('h','high') THEN 'high' END"
TIER = "CASE WHEN frp >= 80 OR brightness >= 355 THEN 'CRITICAL' WHEN frp >= 35 OR brightness >= 340 THEN 'HIGH' ELSE 'MODERATE' END"
SEASON = "CASE WHEN month IN (12,1,2) THEN 'winter' WHEN month BETWEEN 3 AND 5 THEN 'summer' WHEN month BETWEEN 6 AND 9 THEN 'monsoon' ELSE 'post_monsoon' END"
MINUTE = "strftime(ts, '%Y-%m-%d %H:%M')"
FEED_ID = (
    "'F-' || strftime({date}, '%Y%m%d') || '-' || {time} || '-' || " + up("latitude*100") + " || '-' || " + up("longitude*100")
)
STATUS = "CASE WHEN abs({0})*100 < 10 THEN 'CONSISTENT_WITH_BASELINE' WHEN abs({0})*100 < 25 THEN 'ELEVATED_ACTIVITY' ELSE 'UNUSUAL_ACTIVITY' END"
RISK = "brightness*0.7E0 + persistence*0.3E0"


def heuristic(source: str) -> str:
    """Scores, best class and risk over a source with the heuristic's inputs."""
    return f"""
 SELECT *, CAST(least(99, floor(round(55 + best.s*40, 6) + 0.5E0)) AS BIGINT) AS class_confidence, best.n AS classification,
  CASE WHEN {RISK} >= 330 THEN 'CRITICAL' WHEN {RISK} >= 305 THEN 'HIGH' WHEN {RISK} >= 280 THEN 'MODERATE' ELSE 'LOW' END AS risk
 FROM (SELECT *, list_max([
   {{'s': round(0.2E0 + CASE WHEN industrial_distance <= 2 THEN 0.42E0 ELSE 0 END + CASE WHEN brightness >= 335 THEN 0.12E0 ELSE 0 END + CASE WHEN confidence >= 80 THEN 0.08E0 ELSE 0 END, 6), 'o': 0, 'n': 'Industrial Fire'}},
   {{'s': round(0.15E0 + CASE WHEN persistence >= 75 THEN 0.35E0 ELSE 0 END, 6), 'o': -1, 'n': 'Gas Flare'}},
   {{'s': round(0.15E0 + CASE WHEN land_class = 'cropland' THEN 0.42E0 ELSE 0 END, 6), 'o': -2, 'n': 'Crop Burning'}},
   {{'s': round(0.15E0 + CASE WHEN land_class = 'forest' THEN 0.42E0 ELSE 0 END, 6), 'o': -3, 'n': 'Wildfire'}},
   {{'s': round(0.15E0 + CASE WHEN land_class = 'mining' THEN 0.42E0 ELSE 0 END, 6), 'o': -4, 'n': 'Mining'}}]) AS best FROM {source})"""


SHORT = "regexp_replace(regexp_replace(printf('%.{1}f', {0}), '0+$', ''), '\\.$', '')"


def factor_text() -> str:
    s = SHORT.format("value", 2)
    spoken = "replace(feature, '_', ' ')"
    parts = [f"WHEN value IS NULL THEN {spoken} || ': value unavailable'"]
    for name, (no, yes) in FLAGS.items():
        parts.append(f"WHEN feature = {q(name)} AND value = 0 THEN {q(no)} WHEN feature = {q(name)} AND value = 1 THEN {q(yes)}")
    for name, pattern in MEASURES.items():
        a, b = pattern.split("{}")
        parts.append(f"WHEN feature = {q(name)} THEN {q(a)} || {s} || {q(b)}")
    parts.append(
        f"WHEN feature = 'thermal_excess' THEN 'Brightness temperature is ' || {SHORT.format('abs(value)', 2)} || ' K ' || CASE WHEN value < 0 THEN 'below' ELSE 'above' END || ' the 300 K reference'"
    )
    for n in (7, 30):
        parts.append(f"WHEN feature = 'persistence_ratio_{n}d' THEN 'Activity recorded on ' || {SHORT.format('value*100', 1)} || '% of the previous {n} days'")
    return "CASE " + " ".join(parts) + f" ELSE upper({spoken}[1]) || {spoken}[2:] || ': ' || {s} END"


FAMILY = (
    "CASE WHEN regexp_matches(feature, '^(active_days_|hotspot_count_|persistence_|persistent_|high_persistence|low_persistence)') THEN 'recurrence' "
    "WHEN feature IN ('frp','log_frp','high_frp_flag') THEN 'power' WHEN feature IN ('is_night','night_fire_flag','hour') THEN 'time' "
    "WHEN feature IN ('month','day_of_year') THEN 'season' ELSE feature END"
)

#: Common tables, in order of dependence: name -> (tables it needs, text).
TABLES: dict[str, tuple[str, str]] = {
    "raw": ("", EVENTS_TO_DETECTIONS),
    "poi": ("", CUSTOMERS_TO_POINTS),
    "der0": ("raw", f"""
 SELECT source_id, latitude, longitude, bright_ti4 AS brightness, CAST(bright_ti5 AS DOUBLE) AS bright_t31, acq_date AS date,
  lpad(CAST(acq_time AS VARCHAR), 4, '0') AS time, satellite, confidence, frp, daynight, type AS firms_type, product AS data_quality,
  CAST(acq_date AS TIMESTAMP) + to_minutes(CAST((acq_time // 100) * 60 + acq_time % 100 AS BIGINT)) AS ts,
  {TRAINING.format('confidence')} AS confidence_score, {LEVEL.format('confidence')} AS confidence_label,
  CASE WHEN frp IS NOT NULL THEN ln(1 + greatest(frp, 0.0E0)) END AS log_frp, bright_ti4 - 300 AS thermal_excess,
  month(acq_date) AS month, dayofyear(acq_date) AS day_of_year, year(acq_date) AS year, CASE WHEN upper(daynight) = 'N' THEN 1 ELSE 0 END AS is_night,
  CAST(floor(latitude/0.05E0) AS BIGINT)*10000 + CAST(floor(longitude/0.05E0) AS BIGINT) AS grid_id
 FROM raw"""),
    "der": ("der0", f"""
 SELECT *, hour(ts) AS hour, {SEASON} AS season,
  'FIRMS_' || strftime(ts, '%Y%m%d%H%M') || '_' || printf('%.4f', latitude) || '_' || printf('%.4f', longitude) AS event_id FROM der0"""),
    "det": ("der", """
 SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY data_quality, satellite, source_id, brightness) AS n
  FROM (SELECT DISTINCT * FROM der WHERE latitude BETWEEN 6 AND 38 AND longitude BETWEEN 65 AND 100)) WHERE n = 1"""),
    "daily": ("det", """
 SELECT grid_id, date, count(*) AS daily_hotspots, sum(frp) AS daily_total_frp, max(brightness) AS daily_max_brightness,
  avg(confidence_score) AS daily_mean_confidence FROM det GROUP BY ALL"""),
    "prior": ("daily", """
 SELECT *, coalesce(sum(daily_hotspots) OVER w7, 0) AS hotspot_count_7d, count(*) OVER w7 AS active_days_7d,
  coalesce(sum(daily_hotspots) OVER w30, 0) AS hotspot_count_30d, count(*) OVER w30 AS active_days_30d FROM daily
 WINDOW w7 AS (PARTITION BY grid_id ORDER BY date RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING),
  w30 AS (PARTITION BY grid_id ORDER BY date RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)"""),
    "scored": ("prior", """
 SELECT *, active_days_7d/7.0E0 AS persistence_ratio_7d, active_days_30d/30.0E0 AS persistence_ratio_30d,
  CASE WHEN active_days_30d >= 5 OR hotspot_count_30d >= 10 THEN 1 ELSE 0 END AS persistent_source_flag,
  CASE WHEN active_days_30d >= 10 OR hotspot_count_30d >= 25 THEN 1 ELSE 0 END AS high_persistence_flag,
  CASE WHEN hotspot_count_30d > 0 THEN coalesce(daily_total_frp, 0)/hotspot_count_30d ELSE 0 END AS frp_per_detection_30d,
  least(greatest(0.5E0*active_days_30d/30 + 0.3E0*least(hotspot_count_30d/25.0E0, 1) + 0.2E0*least(active_days_7d/7.0E0, 1), 0), 1) AS persistence_score
 FROM prior"""),
    "feats": ("det scored", "SELECT * FROM det LEFT JOIN scored USING (grid_id, date)"),
    "thr": ("det", "SELECT quantile_cont(frp, 0.9) AS high_frp_threshold FROM det"),
    "flagged": ("feats thr", """
 SELECT *, is_night AS night_fire_flag, CASE WHEN active_days_7d >= 3 OR active_days_30d >= 10 THEN 1 ELSE 0 END AS persistent_activity,
  CASE WHEN frp >= high_frp_threshold THEN 1 ELSE 0 END AS high_frp_flag, CASE WHEN active_days_30d <= 2 THEN 1 ELSE 0 END AS low_persistence_flag
 FROM feats, thr"""),
    "dist": ("det poi", f"""
 SELECT p.latitude, p.longitude, min(CASE WHEN category = 'industrial' THEN km END) AS distance_to_industrial_km,
  min(CASE WHEN category = 'mining' THEN km END) AS distance_to_mining_km, min(CASE WHEN category = 'gas' THEN km END) AS distance_to_gas_km
 FROM (SELECT s.latitude, s.longitude, category, {hv('s.latitude', 's.longitude', 'o.latitude', 'o.longitude')} AS km
  FROM (SELECT DISTINCT latitude, longitude FROM det) s, poi o) p GROUP BY ALL"""),
    "located": ("flagged dist", """
 SELECT *, CASE WHEN distance_to_industrial_km <= 1 THEN 1 ELSE 0 END AS near_industrial_1km, CASE WHEN distance_to_mining_km <= 2 THEN 1 ELSE 0 END AS near_mining_2km,
  CASE WHEN distance_to_gas_km <= 1 THEN 1 ELSE 0 END AS near_gas_1km FROM flagged JOIN dist USING (latitude, longitude)"""),
    "lab0": ("located", """
 SELECT *, CASE WHEN near_gas_1km = 1 AND active_days_30d >= 5 THEN 'gas_flare' WHEN near_mining_2km = 1 AND persistent_activity = 1 THEN 'mining_thermal_source'
  WHEN near_industrial_1km = 1 AND persistent_activity = 1 THEN 'industrial_fire' WHEN low_persistence_flag = 1 AND month IN (3,4,5,10,11) THEN 'agricultural_burning'
  WHEN persistent_activity = 1 AND distance_to_industrial_km > 2 AND distance_to_mining_km > 2 AND distance_to_gas_km > 2 THEN 'wildfire' ELSE 'unknown' END AS fire_type
 FROM located"""),
    "labelled": ("lab0", """
 SELECT *, CASE WHEN fire_type IN ('gas_flare','mining_thermal_source') THEN 'high' WHEN fire_type = 'unknown' THEN 'low' ELSE 'medium' END AS label_confidence FROM lab0"""),
    "cells": ("det", "SELECT grid_id, avg(latitude) AS latitude, avg(longitude) AS longitude, count(*) AS n FROM det GROUP BY ALL"),
    "pred": ("det", f"""
 SELECT event_id, source_id, fire_type, w / sum(w) OVER (PARTITION BY event_id) AS p FROM (
  SELECT event_id, source_id, {CLASS_LIST}[i] AS fire_type, CAST(1 + source_id*((i+2)*7) % 11 AS DOUBLE) AS w FROM det, (SELECT unnest(range(1,6)) AS i))"""),
    "best": ("pred", """
 SELECT event_id, fire_type AS predicted_fire_type, p AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, fire_type) AS n FROM pred) WHERE n = 1"""),
    "contrib": ("flagged", "\n UNION ALL ".join(
        f"SELECT event_id, {q(f)} AS feature, CAST({f} AS DOUBLE) AS value, (source_id*{(i + 2) * 13} % 21 - 10)/100.0E0 AS contribution FROM flagged"
        for i, f in enumerate(EXPLAINED))),
    "feed": ("raw", f"""
 SELECT latitude, longitude, coalesce(bright_ti4, bright_ti5, 0.0E0) AS brightness, {SERVING.format('confidence')} AS confidence, acq_date,
  lpad(CAST(acq_time AS VARCHAR), 4, '0') AS acq_time, satellite, coalesce(frp, 0.0E0) AS frp FROM raw"""),
    "feedin": ("feed", f"""
 SELECT *, {FEED_ID.format(date='acq_date', time='acq_time')} AS id, 0.0E0 AS persistence, 10.0E0 AS industrial_distance, 'unknown' AS land_class FROM feed"""),
    "feedev": ("feedin", f"""
 SELECT id, latitude, longitude, classification, class_confidence AS confidence, risk, brightness, 'FEED_' || satellite AS source, satellite, frp FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY brightness DESC, confidence, satellite, frp) AS n FROM ({heuristic('feedin')})) WHERE n = 1"""),
    "typed": ("det best", f"""
 SELECT d.*, CASE WHEN firms_type IS NOT NULL THEN 'Type ' || firms_type
   WHEN predicted_fire_type IS NOT NULL THEN {cases('predicted_fire_type', PREDICTED_LABELS, "'?'")} || ' (predicted)' ELSE 'Unclassified' END AS display_type
 FROM det d LEFT JOIN (SELECT * FROM best WHERE ascii(md5(event_id)[1]) % 3 <> 0) USING (event_id)"""),
    "newest": ("det", "SELECT event_id AS id, latitude, longitude, epoch(ts) AS sec FROM det"),
    "edges": ("newest", f"""
 SELECT * FROM (SELECT a.id AS id_a, b.id AS id_b, {hv('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS km
  FROM newest a JOIN newest b ON a.id < b.id AND abs(a.sec - b.sec) <= 168*3600) WHERE km <= 25"""),
    "places": ("poi", "SELECT osm_id AS id, latitude, longitude, 300.0E0 + osm_id % 80 AS brightness FROM poi"),
    "days": ("det", """
 SELECT *, day_no - lag(day_no) OVER (PARTITION BY grid_id ORDER BY day_no) AS gap, day_no - row_number() OVER (PARTITION BY grid_id ORDER BY day_no) AS island,
  max(day_no) OVER (PARTITION BY grid_id) AS as_of FROM (
  SELECT grid_id, date, datediff('day', DATE '1970-01-01', date) AS day_no, count(*) AS n FROM det GROUP BY ALL)"""),
    "hp0": ("days", """
 SELECT grid_id, count(*) FILTER (as_of - day_no < 30) AS active_days, sum(n) FILTER (as_of - day_no < 30) AS total_observations, max(as_of) AS as_of,
  min(day_no) FILTER (as_of - day_no < 30) AS first_inside, coalesce(sum(n) FILTER (as_of - day_no < 7), 0) AS last7,
  coalesce(sum(n) FILTER (as_of - day_no >= 7 AND as_of - day_no < 14), 0) AS prev7 FROM days GROUP BY grid_id"""),
    "runs": ("days", """
 SELECT grid_id, max(rw) AS longest_streak_days, max(CASE WHEN e = a THEN r END) AS current_streak_days FROM (
  SELECT grid_id, island, count(*) FILTER (as_of - day_no < 30) AS rw, count(*) AS r, max(day_no) AS e, max(as_of) AS a FROM days GROUP BY ALL) GROUP BY grid_id"""),
    "hpers": ("hp0 runs", f"""
 SELECT *, CASE WHEN trend_ratio >= 1.3 THEN 'RISING' WHEN trend_ratio <= 0.7 THEN 'FALLING' WHEN trend_ratio IS NOT NULL THEN 'STABLE' WHEN last7 > 0 THEN 'RISING' ELSE 'UNKNOWN' END AS recent_trend,
  {up('100*(0.7E0*least(1.0E0, active_days/30.0E0) + 0.3E0*least(1.0E0, current_streak_days/30.0E0))')} AS recurrence_index,
  CASE WHEN active_days >= 2 THEN round((as_of - first_inside)/CAST(active_days - 1 AS DOUBLE), 2) END AS typical_recurrence_days
 FROM (SELECT *, CASE WHEN prev7 > 0 THEN round(last7/CAST(prev7 AS DOUBLE), 2) END AS trend_ratio FROM hp0 JOIN runs USING (grid_id))"""),
    "hrec": ("det", """
 SELECT grid_id, date, count(*) AS observation_count, floor((max(brightness))*1e1 + 0.5000001E0)/1e1 AS peak_brightness_k, floor((avg(brightness))*1e1 + 0.5000001E0)/1e1 AS mean_brightness_k,
  floor((max(frp) FILTER (frp > 0))*1e1 + 0.5000001E0)/1e1 AS peak_frp_mw, floor((avg(frp) FILTER (frp > 0))*1e1 + 0.5000001E0)/1e1 AS mean_frp_mw, string_agg(DISTINCT satellite, ',' ORDER BY satellite) AS satellites,
  string_agg(DISTINCT data_quality, ',' ORDER BY data_quality) AS data_quality, count(*) FILTER (confidence_label = 'high') AS n_high,
  count(*) FILTER (confidence_label = 'low') AS n_low, count(*) FILTER (confidence_label = 'nominal') AS n_nominal FROM det GROUP BY ALL"""),
    "hdays": ("hrec", """
 SELECT *, CASE WHEN greatest(n_high, n_low, n_nominal) = 0 THEN NULL WHEN n_high >= n_low AND n_high >= n_nominal THEN 'high' WHEN n_low >= n_nominal THEN 'low' ELSE 'nominal' END AS dominant_confidence FROM hrec"""),
    "spread": ("det", f"""
 SELECT a.grid_id, a.date, CASE WHEN any_value(c.n) >= 2 THEN max({hv('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude', HISTORY_RADIUS)}) END AS estimated_spread_km
 FROM det a JOIN det b USING (grid_id, date) JOIN (SELECT grid_id, date, count(*) AS n FROM det GROUP BY ALL) c USING (grid_id, date) GROUP BY a.grid_id, a.date"""),
    "hbase": ("det hrec", f"""
 SELECT grid_id, n AS observations_used, CASE WHEN n < 5 THEN 'INSUFFICIENT_HISTORY' ELSE {STATUS.format('dev')} END AS status,
  CASE WHEN n >= 5 THEN round(med, 1) END AS historical_median_k, CASE WHEN n >= 5 THEN round(cur, 1) END AS current_k, CASE WHEN n >= 5 THEN round(dev, 4) END AS deviation_ratio
 FROM (SELECT *, (cur - med)/med AS dev FROM (SELECT grid_id, count(*) AS n, median(brightness) AS med FROM det GROUP BY grid_id)
  JOIN (SELECT grid_id, max_by(peak_brightness_k, date) AS cur FROM hrec GROUP BY grid_id) USING (grid_id))"""),
    "hbeh": ("cells hpers", """
 SELECT grid_id, CASE WHEN n <= 2 THEN 'ISOLATED_TRANSIENT_DETECTION' WHEN trend_ratio >= 2 AND n >= 5 THEN 'RECENT_ESCALATION' WHEN active_days/30.0E0 >= 0.5 THEN 'PERSISTENT_SOURCE'
   WHEN active_days/30.0E0 >= 0.15 THEN 'INTERMITTENT_RECURRING_SOURCE' ELSE 'ISOLATED_TRANSIENT_DETECTION' END AS label,
  CASE WHEN n <= 2 THEN 'Only ' || n || ' observation(s) on record; no recurring pattern detected.'
   WHEN trend_ratio >= 2 AND n >= 5 THEN 'Recent 7-day activity is ' || printf('%.2f', trend_ratio) || 'x the preceding 7-day activity.'
   WHEN active_days/30.0E0 >= 0.5 THEN 'Active on ' || active_days || ' of the last 30 days.'
   WHEN active_days/30.0E0 >= 0.15 THEN 'Active on ' || active_days || ' of the last 30 days, with gaps between detections.'
   ELSE 'Sparse activity with no established recurrence in the analysis window.' END AS explanation
 FROM cells JOIN hpers USING (grid_id)"""),
    "cpairs": ("det", f"""
 SELECT * FROM (SELECT a.grid_id, a.event_id, b.event_id AS event_id2, a.satellite, b.satellite AS satellite2, a.ts AS at1, b.ts AS at2,
   {hv('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude', HISTORY_RADIUS)} AS km, (epoch(b.ts) - epoch(a.ts))/3600.0E0 AS hours
  FROM det a JOIN det b ON a.grid_id = b.grid_id AND a.satellite <> b.satellite AND (a.ts < b.ts OR a.ts = b.ts AND a.event_id < b.event_id) AND epoch(b.ts) - epoch(a.ts) <= 21600)
 WHERE km <= 2"""),
    "hcor": ("det cpairs", """
 SELECT grid_id, CASE WHEN m.grid_id IS NULL THEN 0 ELSE 1 END AS corroborated,
  CASE WHEN m.grid_id IS NULL THEN s.sats ELSE least(m.satellite, m.satellite2) || ',' || greatest(m.satellite, m.satellite2) END AS satellites, s.n AS satellite_count,
  round(m.km, 3) AS spatial_agreement_km, round(m.hours, 2) AS temporal_separation_hours,
  CASE WHEN s.n < 2 THEN 'Fewer than two distinct satellites observed this cluster.' WHEN m.grid_id IS NULL THEN 'No cross-satellite observations within 2.0 km / 6h of each other.'
   ELSE 'Independent satellites observed the same cluster within the matching thresholds.' END AS reason
 FROM (SELECT grid_id, string_agg(DISTINCT satellite, ',' ORDER BY satellite) AS sats, count(DISTINCT satellite) AS n FROM det GROUP BY grid_id) s
 LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY at1 DESC, at2, km) AS r FROM cpairs) WHERE r = 1) m USING (grid_id)"""),
    "hfing": ("det days spread hpers", """
 SELECT grid_id, CASE WHEN total >= 8 THEN 1 ELSE 0 END AS available,
  CASE WHEN total < 8 THEN 'UNKNOWN' WHEN active_days/30.0E0 >= 0.5 THEN 'HIGH' WHEN active_days/30.0E0 >= 0.2 THEN 'MODERATE' ELSE 'LOW' END AS persistence,
  CASE WHEN total < 8 OR gaps < 3 THEN 'UNKNOWN' WHEN 25*gaps*gap_squares < 34*gap_sum*gap_sum THEN 'REGULAR' ELSE 'IRREGULAR' END AS recurrence,
  CASE WHEN total < 8 OR sp IS NULL THEN 'UNKNOWN' WHEN sp <= 2 THEN 'HIGH' WHEN sp <= 5 THEN 'MODERATE' ELSE 'LOW' END AS spatial_stability,
  CASE WHEN total < 8 THEN 'UNKNOWN' ELSE recent_trend END AS recent_trend,
  CASE WHEN total < 8 THEN 'UNKNOWN' WHEN total/CAST(span AS DOUBLE) >= 1 THEN 'HIGH' WHEN total/CAST(span AS DOUBLE) >= 0.2 THEN 'MODERATE' ELSE 'LOW' END AS observation_frequency,
  CASE WHEN total < 8 THEN 'UNKNOWN' WHEN night >= 0.7 THEN 'MOSTLY_NIGHT' WHEN night <= 0.3 THEN 'MOSTLY_DAY' ELSE 'MIXED' END AS day_night_behavior
 FROM (SELECT grid_id, count(*) AS total, avg(is_night) AS night FROM det GROUP BY grid_id)
 JOIN (SELECT grid_id, count(gap) AS gaps, sum(gap) AS gap_sum, sum(gap*gap) AS gap_squares, max(day_no) - min(day_no) + 1 AS span FROM days GROUP BY grid_id) USING (grid_id)
 JOIN (SELECT grid_id, avg(estimated_spread_km) AS sp FROM spread GROUP BY grid_id) USING (grid_id) JOIN hpers USING (grid_id)"""),
    "hesc": ("days", """
 SELECT grid_id, CASE WHEN ratio IS NULL THEN 'INSUFFICIENT_HISTORY' WHEN ratio >= 2 THEN 'RECENT_ESCALATION' ELSE 'STABLE' END AS status, ratio,
  CASE WHEN ratio >= 2 THEN CAST(DATE '1970-01-01' + CAST(as_of - 7 AS INTEGER) AS VARCHAR) END AS comparison_window_start
 FROM (SELECT *, CASE WHEN total >= 15 AND span >= 21 AND ps IS NOT NULL THEN round((recent/7.0E0)/(prior/CAST(greatest(ps, 1) AS DOUBLE)), 2) END AS ratio FROM (
  SELECT grid_id, sum(n) AS total, max(day_no) - min(day_no) + 1 AS span, max(as_of) AS as_of, coalesce(sum(n) FILTER (as_of - day_no < 7), 0) AS recent,
   coalesce(sum(n) FILTER (as_of - day_no >= 7), 0) AS prior, max(day_no) FILTER (as_of - day_no >= 7) - min(day_no) FILTER (as_of - day_no >= 7) + 1 AS ps FROM days GROUP BY grid_id))"""),
    "hfoot": ("det cells", f"""
 SELECT grid_id, CASE WHEN any_value(c.n) >= 3 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS status,
  CASE WHEN any_value(c.n) >= 3 THEN round(max({hv('c.latitude', 'c.longitude', 'd.latitude', 'd.longitude', HISTORY_RADIUS)}), 3) END AS max_radius_km, any_value(c.n) AS observations_used
 FROM det d JOIN cells c USING (grid_id) GROUP BY grid_id"""),
    "hres": ("places cells", f"""
 SELECT id, cell AS cluster_id, CASE WHEN exact THEN 'exact_cell' ELSE 'neighbor_cell' END AS match_method, round(km, 3) AS match_distance_km FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN exact AND n >= 2 THEN 0 WHEN NOT exact THEN 1 ELSE 2 END, km, cell) AS r FROM (
   SELECT p.id, c.grid_id AS cell, c.n, c.grid_id = p.own AS exact, {hv('p.latitude', 'p.longitude', 'c.latitude', 'c.longitude', HISTORY_RADIUS)} AS km
   FROM (SELECT *, CAST(floor(latitude/0.05E0) AS BIGINT)*10000 + CAST(floor(longitude/0.05E0) AS BIGINT) AS own FROM places) p,
    (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j), cells c WHERE c.grid_id = p.own + i*10000 + j) WHERE exact OR km <= 8) WHERE r = 1"""),
    "tolrows": ("labelled", """
 SELECT event_id, latitude, longitude, date, time, satellite, fire_type FROM labelled
 UNION ALL SELECT event_id || '#2', latitude, longitude, date, time, satellite, fire_type FROM labelled WHERE source_id % 49 = 0"""),
    "tol": ("det tolrows", """
 SELECT id, CASE WHEN n = 1 THEN 'matched' WHEN n = 0 THEN 'unmatched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN e END AS event_id, CASE WHEN n = 1 THEN f END AS fire_type FROM (
  SELECT p.id, count(r.event_id) AS n, min(r.event_id) AS e, min(r.fire_type) AS f FROM (
   SELECT event_id AS id, CASE WHEN source_id % 35 = 0 THEN latitude + 0.001E0 ELSE round(latitude, 5) END AS latitude, round(longitude, 5) AS longitude, date, time,
    CASE WHEN source_id % 21 = 0 THEN CASE WHEN satellite = 'N20' THEN 'N21' ELSE 'N20' END ELSE satellite END AS satellite FROM det) p
  LEFT JOIN tolrows r ON p.date = r.date AND p.time = r.time AND p.satellite = r.satellite AND abs(p.latitude - r.latitude) < 1e-5 AND abs(p.longitude - r.longitude) < 1e-5 GROUP BY p.id)"""),
    "evald": ("labelled best", "SELECT l.event_id, fire_type, predicted_fire_type FROM labelled l JOIN best USING (event_id) WHERE fire_type <> 'unknown'"),
    "nextday": ("daily", """
 SELECT a.*, CASE WHEN b.grid_id IS NULL THEN 0 ELSE 1 END AS wildfire_next_24h FROM daily a LEFT JOIN (SELECT grid_id, date FROM daily) b ON a.grid_id = b.grid_id AND b.date = a.date + 1"""),
    "comp": ("newest edges", """
 SELECT id, min(r) AS component FROM reach GROUP BY id"""),
}

REACH = """reach AS (
 SELECT id, id AS r FROM newest UNION SELECT e.b, reach.r FROM reach JOIN (SELECT id_a AS a, id_b AS b FROM edges UNION ALL SELECT id_b, id_a FROM edges) e ON e.a = reach.id)"""

#: name -> (tables it needs, select).
BODIES: dict[str, tuple[str, str]] = {
    "scan_union_detections": ("raw", "SELECT * FROM raw"),
    "scan_standardized": ("raw", "SELECT source_id, bright_ti4 AS brightness, CAST(bright_ti5 AS DOUBLE) AS bright_t31, acq_date AS date, CAST(acq_time AS VARCHAR) AS time, CASE WHEN source_id % 7 <> 0 THEN frp END AS frp, type AS firms_type, confidence FROM raw"),
    "feed_normalized": ("feed", "SELECT * FROM feed"),
    "sink_parquet_roundtrip": ("det", "SELECT * FROM det"),
    "sink_json_roundtrip": ("hrec", "SELECT grid_id, count(*) AS days, sum(observation_count) AS observations, max(peak_brightness_k) AS peak FROM hrec GROUP BY grid_id"),
    "snapshot_explode": ("det", "SELECT event_id AS id, date AS from_date, round(latitude, 5) AS latitude, round(longitude, 5) AS longitude, brightness, date, time, satellite FROM det"),
    "poi_normalized": ("poi", "SELECT osm_id, CASE WHEN osm_id % 3 <> 0 THEN 'node' ELSE 'way' END AS osm_type, latitude, longitude, category, name, landuse FROM poi WHERE osm_id % 9 <> 0"),
    "upsert_events": ("feedev", """
 SELECT id, CASE WHEN c.id IS NULL THEN u.latitude ELSE c.latitude END AS latitude, CASE WHEN u.id IS NULL THEN c.brightness ELSE u.brightness END AS brightness,
  coalesce(u.confidence, c.confidence) AS confidence, coalesce(u.risk, c.risk) AS risk, coalesce(u.classification, c.classification) AS classification, coalesce(u.source, c.source) AS source
 FROM (SELECT * FROM feedev WHERE CAST('0x' || md5(id)[1:4] AS INTEGER) % 3 <> 0) c
 FULL OUTER JOIN (SELECT * REPLACE (brightness + 5 AS brightness, latitude + 1 AS latitude) FROM feedev WHERE CAST('0x' || md5(id)[1:4] AS INTEGER) % 2 = 0) u USING (id)"""),
    "profile_nulls": ("det", " UNION ALL ".join(f"SELECT {q(x)} AS column_name, count(*) AS nulls FROM det WHERE {x} IS NULL HAVING count(*) > 0" for x in ("latitude", "brightness", "frp", "log_frp", "firms_type", "confidence_score"))),
    "profile_value_counts": ("det", " UNION ALL ".join(f"SELECT {q(x)} AS column_name, CAST({x} AS VARCHAR) AS value, count(*) AS n FROM det GROUP BY {x}" for x in ("satellite", "confidence_label", "daynight", "data_quality", "season", "firms_type"))),
    "persistence_report": ("feats", f"""
 SELECT count(*) AS rows, count(DISTINCT grid_id) AS cells, count(DISTINCT (grid_id, date)) AS cell_days, count(DISTINCT CASE WHEN persistent_source_flag = 1 THEN (grid_id, date) END) AS persistent_cell_days,
  count(DISTINCT CASE WHEN high_persistence_flag = 1 THEN (grid_id, date) END) AS high_persistence_cell_days, sum(persistent_source_flag) AS persistent_detections,
  sum(high_persistence_flag) AS high_persistence_detections, {MINUTE.replace('ts', 'min(ts)')} AS first_time, {MINUTE.replace('ts', 'max(ts)')} AS last_time FROM feats"""),
    "proj_timestamp": ("raw", """
 SELECT source_id, CASE WHEN bad THEN NULL ELSE lpad(CAST(acq_time AS VARCHAR), 4, '0') END AS time,
  CASE WHEN bad THEN NULL ELSE strftime(CAST(acq_date AS TIMESTAMP) + to_minutes(CAST((acq_time // 100) * 60 + acq_time % 100 AS BIGINT)), '%Y-%m-%d %H:%M') END AS seen_at
 FROM (SELECT *, source_id % 3 <> 0 AND source_id % 17 = 0 AS bad FROM raw)"""),
    "proj_confidence": ("raw", f"SELECT source_id, {TRAINING.format('t')} AS training, {SERVING.format('t')} AS serving, {LEVEL.format('t')} AS label FROM (SELECT source_id, CASE WHEN source_id % 5 = 0 THEN upper(confidence) WHEN source_id % 9 = 0 THEN '72' ELSE confidence END AS t FROM raw)"),
    "proj_thermal": ("det", "SELECT * FROM det"),
    "proj_calendar": ("det", "SELECT *, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM det"),
    "proj_season": ("det", "SELECT * FROM det"),
    "proj_flags": ("det", "SELECT *, CASE WHEN ts < TIMESTAMP '2024-03-01' THEN 'ARCHIVE' ELSE 'NRT' END AS product_by_date FROM det"),
    "proj_event_id": ("der", f"SELECT source_id, event_id, {FEED_ID.format(date='date', time='time')} AS feed_id FROM der"),
    "proj_grid": ("det", f"SELECT event_id, grid_id, CAST(floor(latitude/0.05E0) AS BIGINT) || '_' || CAST(floor(longitude/0.05E0) AS BIGINT) AS grid_text, {up('latitude*100')} || ':' || {up('longitude*100')} AS small_cell FROM det"),
    "proj_haversine": ("det", f"SELECT event_id, {hv('latitude', 'longitude', '20.0E0', '80.0E0')} AS km, {hv('latitude', 'longitude', '20.0E0', '80.0E0', HISTORY_RADIUS)} AS km_history FROM det"),
    "proj_bearing": ("det", f"""
 SELECT event_id, b AS bearing, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][1 + CAST(floor(b/22.5E0 + 0.5E0) AS BIGINT) % 16] AS compass,
  CASE WHEN km <= 1 THEN 'near' WHEN km <= 5 THEN 'mid' ELSE 'far' END AS ring FROM (
  SELECT event_id, (degrees(atan2(sin(radians(longitude) - radians(80.0E0))*cos(radians(latitude)), cos(radians(20.0E0))*sin(radians(latitude)) - sin(radians(20.0E0))*cos(radians(latitude))*cos(radians(longitude) - radians(80.0E0)))) + 360) % 360.0E0 AS b,
   {hv('20.0E0', '80.0E0', 'latitude', 'longitude')}/100 AS km FROM det)"""),
    "proj_model_flags": ("flagged", "SELECT * FROM flagged"),
    "proximity_flags": ("located", """
 SELECT *, CASE WHEN distance_to_industrial_km <= 5 OR distance_to_gas_km*2 <= 5 OR length(event_id) % 5 >= 3 THEN 1 ELSE 0 END AS industrial_context_flag,
  CASE WHEN distance_to_industrial_km <= 2 OR distance_to_gas_km*2 <= 2 THEN 1 ELSE 0 END AS strong_industrial_context_flag FROM located"""),
    "proj_landcover": ("raw", f"""
 SELECT source_id, l AS land_label, CASE WHEN lower(l) LIKE '%industrial%' THEN 'industrial' WHEN lower(l) LIKE '%forest%' OR lower(l) LIKE '%tree%' THEN 'forest'
  WHEN lower(l) LIKE '%crop%' OR lower(l) LIKE '%farm%' OR lower(l) LIKE '%agri%' THEN 'cropland' WHEN lower(l) LIKE '%mine%' THEN 'mining' ELSE 'unknown' END AS land_class
 FROM (SELECT source_id, {cases('(source_id % 12)*10', LAND_COVER, "'Unknown'")} AS l FROM raw)"""),
    "label_fire_type": ("labelled", "SELECT * FROM labelled"),
    "score_heuristic": ("det", "SELECT *, CASE WHEN industrial_distance <= 2 THEN 0.42E0 ELSE -0.08E0 END AS c_industrial, CASE WHEN brightness >= 335 THEN 0.31E0 ELSE 0.12E0 END AS c_thermal, CASE WHEN persistence >= 75 THEN 0.24E0 ELSE 0.08E0 END AS c_persistence, CASE WHEN confidence >= 80 THEN 0.18E0 ELSE 0.05E0 END AS c_confidence FROM (" + heuristic(f"(SELECT event_id, brightness, {SERVING.format('confidence')} AS confidence, CAST(source_id % 100 AS DOUBLE) AS persistence, CAST(source_id % 7 AS DOUBLE) AS industrial_distance, ['cropland','forest','mining','unknown'][1 + source_id % 4] AS land_class FROM det)") + ")"),
    "score_risk": ("located", """
 SELECT event_id, risk_score, CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 55 THEN 'High' WHEN risk_score >= 30 THEN 'Moderate' ELSE 'Low' END AS risk_level,
  floor((c)*1e2 + 0.5000001E0)/1e2 AS model_confidence, floor((f)*1e2 + 0.5000001E0)/1e2 AS frp_intensity, floor((p)*1e2 + 0.5000001E0)/1e2 AS persistence_component, round(i, 2) AS infrastructure
 FROM (SELECT *, floor((least(greatest(c*0.30E0 + f*0.25E0 + p*0.25E0 + i*0.15E0 + persistent_activity*5, 0), 100))*1e2 + 0.5000001E0)/1e2 AS risk_score FROM (
  SELECT event_id, (source_id % 101)/100.0E0*100 AS c, least(greatest(coalesce(frp, 0)/300*100, 0), 100) AS f, least(greatest(persistence_score*100, 0), 100) AS p,
   CAST(near_gas_1km*20 + near_industrial_1km*20 + near_mining_2km*15 AS DOUBLE) AS i, persistent_activity FROM located))"""),
    "score_tier": ("det", f"SELECT event_id, {TIER} AS tier FROM det"),
    "geo_support": ("labelled", """
 SELECT event_id, CASE WHEN n = 0 THEN 'no_direct_proximity_evidence' ELSE e END AS evidence, r AS support_score, k AS conflicts, CASE WHEN k > 0 THEN 'conflict' WHEN r > 0 THEN 'supported' ELSE 'neutral' END AS support_level
 FROM (SELECT *, CASE WHEN fire_type IN ('wildfire','agricultural_burning') THEN CASE WHEN n = 0 THEN 1 ELSE 0 END ELSE coalesce(need, 0) END AS r,
   CASE WHEN fire_type IN ('wildfire','agricultural_burning') THEN n ELSE coalesce(1 - need, 0) END AS k FROM (
  SELECT event_id, fire_type, near_gas_1km + near_industrial_1km + near_mining_2km AS n, CASE fire_type WHEN 'gas_flare' THEN near_gas_1km WHEN 'industrial_fire' THEN near_industrial_1km WHEN 'mining_thermal_source' THEN near_mining_2km END AS need,
   concat_ws(',', CASE WHEN near_gas_1km = 1 THEN 'gas_infrastructure' END, CASE WHEN near_industrial_1km = 1 THEN 'industrial_infrastructure' END, CASE WHEN near_mining_2km = 1 THEN 'mining_activity' END) AS e FROM labelled))"""),
    "validate_observations": ("feats", """
 SELECT event_id, concat_ws(',', CASE WHEN b < 200 OR b > 500 THEN 'brightness' END, CASE WHEN frp IS NULL OR frp < 0 THEN 'frp' END, CASE WHEN dn NOT IN ('D','N') THEN 'daynight' END,
  CASE WHEN a7 > 7 THEN 'active_days_7d' END, CASE WHEN active_days_30d < a7 OR active_days_30d > a7 + 23 THEN 'window_days' END,
  CASE WHEN hotspot_count_7d < a7 OR hotspot_count_30d < active_days_30d OR hotspot_count_30d < hotspot_count_7d OR hotspot_count_30d - hotspot_count_7d < active_days_30d - a7 THEN 'window_counts' END,
  CASE WHEN (a7 = 0) <> (hotspot_count_7d = 0) OR (active_days_30d = a7) <> (hotspot_count_30d = hotspot_count_7d) THEN 'window_zeros' END,
  CASE WHEN daily_total_frp IS NULL OR frp IS NULL OR daily_total_frp < frp THEN 'daily_total_frp' END, CASE WHEN daily_max_brightness < b THEN 'daily_max_brightness' END) AS violations
 FROM (SELECT *, CASE WHEN source_id % 13 = 0 THEN 150.0E0 ELSE brightness END AS b, CASE WHEN source_id % 17 = 0 THEN 8 ELSE active_days_7d END AS a7, CASE WHEN source_id % 19 = 0 THEN 'X' ELSE daynight END AS dn FROM feats)"""),
    "feature_parity": ("feats", """
 SELECT feature, count(*) AS compared, sum(CASE WHEN abs(a - b) > 2e-5 + 2e-6*abs(b) THEN 1 ELSE 0 END) AS out_of_tolerance FROM (
  SELECT 'log_frp' AS feature, CASE WHEN source_id % 29 = 0 THEN log_frp + 0.001E0 ELSE log_frp END AS a, log_frp AS b FROM feats UNION ALL SELECT 'thermal_excess', thermal_excess, brightness - 300 FROM feats
  UNION ALL SELECT 'persistence_ratio_30d', persistence_ratio_30d, active_days_30d/30.0E0 FROM feats UNION ALL SELECT 'persistence_score', persistence_score, 0.5E0*active_days_30d/30 + 0.3E0*least(hotspot_count_30d/25.0E0, 1) + 0.2E0*active_days_7d/7 FROM feats)
 WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY feature"""),
    "proj_density_band": ("det", "SELECT event_id, least(1.0E0, 0.18E0 + (brightness - 280)/100 + coalesce(frp, 0)/500) AS weight, CASE WHEN brightness < 320 THEN 'low' WHEN brightness < 335 THEN 'moderate' WHEN brightness < 350 THEN 'high' ELSE 'extreme' END AS band FROM det"),
    "proj_event_shape": ("feedev", "SELECT id, satellite, frp, 0 AS persistence_days, classification, risk FROM feedev"),
    "alert_sla": ("", """
 SELECT id, risk, status, m AS age_minutes, CASE WHEN status = 'resolved' THEN 'resolved' WHEN m >= 2*w THEN 'breach' WHEN m >= w THEN 'warn' ELSE 'ok' END AS sla,
  CASE status WHEN 'new' THEN 'ack' WHEN 'ack' THEN 'resolved' ELSE 'new' END AS next_status FROM (
  SELECT *, CASE risk WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 15 ELSE 30 END AS w FROM (
   SELECT event_id AS id, ['CRITICAL','HIGH','MODERATE'][1 + event_id % 3] AS risk, ['new','ack','resolved','new'][1 + event_id % 4] AS status,
    CAST(floor((floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(ts)))/60) AS BIGINT) AS m FROM events WHERE event_type = 'error'))"""),
    "factor_text": ("contrib", f"SELECT event_id, feature, {factor_text()} AS text FROM contrib"),
    "poi_categories": ("poi", """
 SELECT osm_id, infra_category FROM (SELECT osm_id, unnest([CASE WHEN lu = 'industrial' OR ref THEN 'industrial' END, CASE WHEN plant THEN 'power_plant' END, CASE WHEN ref OR works THEN 'refinery' END,
   CASE WHEN lu = 'landfill' THEN 'landfill' END, CASE WHEN lu = 'quarry' THEN 'mine' END, CASE WHEN lu = 'industrial' OR ref OR plant OR works OR silo THEN 'industrial_poi' END]) AS infra_category
  FROM (SELECT osm_id, coalesce(CASE WHEN landuse = 'quarry' THEN 'quarry' WHEN osm_id % 5 = 0 THEN 'industrial' WHEN osm_id % 5 = 1 THEN 'landfill' END, '') AS lu, osm_id % 7 = 0 AS plant, osm_id % 11 = 0 AS ref, osm_id % 13 = 0 AS works, osm_id % 13 = 1 AS silo FROM poi))
 WHERE infra_category IS NOT NULL"""),
    "proj_local_time": ("det", f"SELECT event_id, {MINUTE.replace('ts', 'ts + INTERVAL 330 MINUTE')} AS local_time FROM det"),
    "filter_region": ("der", f"SELECT *, {MINUTE} AS seen_at FROM der WHERE latitude BETWEEN 10 AND 30 AND longitude BETWEEN 70 AND 90"),
    "filter_trailing_window": ("det", "SELECT * FROM det WHERE date > (SELECT max(date) FROM det) - 7"),
    "filter_priority_search": ("det", f"SELECT * FROM (SELECT *, {TIER} AS tier FROM det) WHERE (brightness >= 340 OR coalesce(frp, 0) >= 35 OR tier IN ('HIGH','CRITICAL')) AND lower(event_id || ' ' || satellite || ' ' || tier) LIKE '%n20%'"),
    "filter_complete_cases": ("flagged", "SELECT event_id FROM flagged WHERE brightness IS NOT NULL AND frp IS NOT NULL AND log_frp IS NOT NULL AND confidence_score IS NOT NULL AND persistence_score IS NOT NULL"),
    "join_persistence_back": ("det prior", "SELECT *, 0 AS duplicate_keys FROM det LEFT JOIN prior USING (grid_id, date)"),
    "join_next_day_label": ("nextday", "SELECT * FROM nextday"),
    "knn_distance": ("dist", "SELECT * FROM dist"),
    "radius_count": ("cells poi", f"SELECT c.grid_id AS id, count(p.osm_id) AS n FROM cells c LEFT JOIN poi p ON {hv('c.latitude', 'c.longitude', 'p.latitude', 'p.longitude')} <= 5 GROUP BY c.grid_id"),
    "knn_top5": ("cells poi", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, right_category ORDER BY km, right_osm_id) AS rank FROM (SELECT c.grid_id AS id, p.category AS right_category, p.osm_id AS right_osm_id, {hv('c.latitude', 'c.longitude', 'p.latitude', 'p.longitude')} AS km FROM cells c, poi p) WHERE km <= 10) WHERE rank <= 5"),
    "resolve_cluster": ("hres", "SELECT * FROM hres"),
    "join_unique_tolerance": ("tol", "SELECT * FROM tol"),
    "agg_match_outcomes": ("tol", "SELECT CASE WHEN status = 'matched' THEN fire_type ELSE status END AS outcome, count(*) AS n FROM tol GROUP BY ALL"),
    "join_rounded_predictions": ("det best", """
 SELECT d.event_id, p.predicted_fire_type FROM det d LEFT JOIN (
  SELECT latitude, longitude, date, time, satellite, predicted_fire_type FROM det JOIN best USING (event_id)
  UNION ALL SELECT latitude, longitude, date, time, satellite, 'wildfire' FROM det WHERE source_id % 30 = 0) p
 ON round(d.latitude, 5) = round(p.latitude, 5) AND round(d.longitude, 5) = round(p.longitude, 5) AND d.date = p.date AND d.time = p.time AND d.satellite = p.satellite"""),
    "corroboration_pairs": ("cpairs", "SELECT * FROM cpairs"),
    "event_edges": ("edges", "SELECT * FROM edges"),
    "persistence_nearby": ("det", f"""
 SELECT id, observations, unique_days, s AS score, CASE WHEN unique_days < 2 THEN 'INSUFFICIENT_HISTORY' WHEN s >= 55 THEN 'PERSISTENT' ELSE 'TRANSIENT' END AS pattern FROM (
  SELECT *, CASE WHEN unique_days < 2 THEN 0 ELSE least(100, {up('unique_days/30.0E0*100')}) END AS s FROM (
   SELECT a.event_id AS id, count(*) AS observations, count(DISTINCT b.date) AS unique_days FROM det a JOIN det b ON abs(a.latitude - b.latitude) < 0.01 AND {hv('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 0.75
   GROUP BY a.event_id))"""),
    "join_lookup_default": ("best", f"SELECT event_id, {cases('predicted_fire_type', {k: v for k, v in CLASS_LABELS.items() if k != 'wildfire'}, q('Unclassified'))} AS display, {cases('predicted_fire_type', {k: f'desk-{i}' for i, k in enumerate(CLASS_LABELS) if k != 'wildfire'}, q('duty officer'))} AS contact FROM best"),
    "nearest_events": ("newest", f"SELECT *, row_number() OVER (ORDER BY km, id) AS rank FROM (SELECT o.id AS selected_id, n.id, {hv('o.latitude', 'o.longitude', 'n.latitude', 'n.longitude')} AS km FROM newest n, (SELECT * FROM newest ORDER BY id LIMIT 1) o WHERE n.id <> o.id ORDER BY km, n.id LIMIT 8)"),
    "strongest_in_box": ("places det", "SELECT id, event_id, brightness FROM (SELECT p.id, d.event_id, d.brightness, row_number() OVER (PARTITION BY p.id ORDER BY d.brightness DESC, d.event_id) AS n FROM places p JOIN det d ON abs(d.latitude - p.latitude) <= 0.2E0 AND abs(d.longitude - p.longitude) <= 0.2E0) WHERE n = 1"),
    "agg_daily_activity": ("daily", "SELECT * FROM daily"),
    "agg_grid_day_wide": ("feats", """
 SELECT grid_id, date, avg(latitude) AS latitude, avg(longitude) AS longitude, count(*) AS fire_count, sum(frp) AS frp_sum, avg(frp) AS frp_mean, max(frp) AS frp_max, avg(brightness) AS brightness_mean, max(brightness) AS brightness_max,
  avg(confidence_score) AS confidence_mean, max(confidence_score) AS confidence_max, """ + ", ".join(f"max({x}) AS {x}" for x in ("hotspot_count_7d", "active_days_7d", "hotspot_count_30d", "active_days_30d", "persistence_ratio_7d", "persistence_ratio_30d", "persistent_source_flag", "high_persistence_flag", "persistence_score", "daily_total_frp", "daily_max_brightness", "daily_mean_confidence")) + ", max(year) AS year, max(month) AS month, max(day_of_year) AS day_of_year, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM feats GROUP BY grid_id, date"),
    "agg_cell_centroid": ("cells", "SELECT * FROM cells"),
    "hist_daily_records": ("hdays", "SELECT * FROM hdays"),
    "hist_daily_spread": ("spread", "SELECT * FROM spread"),
    "agg_high_frp": ("flagged", "SELECT * FROM flagged"),
    "agg_snapshot_persistence": ("det", f"SELECT *, {up('active_days/30.0E0*100')} AS score FROM (SELECT {up('latitude*100')} || ':' || {up('longitude*100')} AS cell, count(DISTINCT date) AS active_days, count(*) AS observations FROM det WHERE date > (SELECT max(date) FROM det) - 30 GROUP BY ALL)"),
    "agg_daily_analytics": ("det", """
 SELECT CAST(c.day AS DATE) AS date, count(d.event_id) AS detections, """ + ", ".join(f"round(coalesce({f}, 0), 4) AS {n}" for n, f in (("total_frp", "sum(frp)"), ("max_frp", "max(frp)"), ("mean_frp", "avg(frp)"), ("max_brightness", "max(brightness)"), ("mean_brightness", "avg(brightness)"))) + """
 FROM (SELECT unnest(generate_series((SELECT max(date) FROM det) - 29, (SELECT max(date) FROM det), INTERVAL 1 DAY)) AS day) c LEFT JOIN det d ON d.date = CAST(c.day AS DATE) GROUP BY c.day"""),
    "agg_daily_types": ("typed", "SELECT date, display_type, count(*) AS n FROM typed WHERE date > (SELECT max(date) FROM typed) - 30 GROUP BY ALL"),
    "agg_type_totals": ("typed", "SELECT display_type, count(*) AS n FROM typed GROUP BY ALL"),
    "agg_crosstab": ("labelled", "SELECT fire_type, count(*) FILTER (label_confidence = 'high') AS high, count(*) FILTER (label_confidence = 'medium') AS medium, count(*) FILTER (label_confidence = 'low') AS low FROM labelled GROUP BY fire_type"),
    "sample_class_cap": ("labelled", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fire_type ORDER BY md5(event_id), event_id) AS class_rank FROM labelled WHERE NOT (fire_type = 'unknown' AND label_confidence = 'low')) WHERE class_rank <= 15000"),
    "sample_balanced": ("nextday", "SELECT * FROM nextday WHERE wildfire_next_24h = 1 UNION ALL SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (ORDER BY md5(grid_id || ':' || date), grid_id || ':' || date) AS n FROM nextday WHERE wildfire_next_24h = 0) WHERE n <= (SELECT 2*sum(wildfire_next_24h) FROM nextday)"),
    "agg_kpis": ("feats", f"SELECT count(*) AS events, count(*) FILTER (t IN ('HIGH','CRITICAL')) AS high_or_critical, count(*) FILTER (round(persistence_score*100, 6) >= 70) AS persistent, round(avg(c), 4) AS mean_confidence FROM (SELECT *, {TIER} AS t, {SERVING.format('confidence')} AS c FROM feats)"),
    "agg_cluster_summary": ("comp newest best", "SELECT component, count(*) AS members, count(DISTINCT predicted_fire_type) AS classes, round(avg(confidence), 4) AS mean_confidence, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east FROM comp JOIN newest USING (id) JOIN best ON best.event_id = id GROUP BY component"),
    "metrics_confusion": ("evald", "SELECT fire_type AS actual, predicted_fire_type AS predicted, count(*) AS n FROM evald GROUP BY ALL"),
    "metrics_report": ("evald", """
 SELECT name, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (
  WITH a AS (SELECT fire_type AS name, count(*) AS support, count(*) FILTER (fire_type = predicted_fire_type) AS tp FROM evald GROUP BY 1),
   s AS (SELECT predicted_fire_type AS name, count(*) AS said FROM evald GROUP BY 1),
   p AS (SELECT name, support, tp, CASE WHEN coalesce(said, 0) > 0 THEN tp/CAST(said AS DOUBLE) ELSE 0 END AS precision, tp/CAST(support AS DOUBLE) AS recall FROM a LEFT JOIN s USING (name)),
   f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2*precision*recall/(precision + recall) ELSE 0 END AS f1 FROM p)
  SELECT name, support, precision, recall, f1 FROM f UNION ALL SELECT '~accuracy', sum(support), NULL, NULL, sum(tp)/CAST(sum(support) AS DOUBLE) FROM f
  UNION ALL SELECT '~macro', sum(support), NULL, NULL, avg(f1) FROM f UNION ALL SELECT '~weighted', sum(support), NULL, NULL, sum(f1*support)/sum(support) FROM f)"""),
    "win_prior_activity": ("prior", "SELECT * FROM prior"),
    "persistence_features": ("feats", "SELECT * FROM feats"),
    "win_top_per_day": ("det", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(strength, 9) DESC, event_id) AS rank FROM (SELECT *, coalesce(frp, 0) + brightness/20 AS strength FROM det)) WHERE rank <= 200"),
    "rank_factors": ("contrib", "SELECT * FROM (SELECT *, sign(contribution) AS sign, row_number() OVER (PARTITION BY event_id, sign(contribution) ORDER BY abs(contribution) DESC, feature) AS rank FROM contrib WHERE contribution <> 0) WHERE rank <= 5"),
    "runner_up": ("pred", """
 SELECT event_id, fire_type, runner_up, round(p1, 6) AS confidence, g AS gap_points, CASE WHEN g >= 0 AND g < 10 THEN 1 ELSE 0 END AS close_call, CASE WHEN p1 < 0.5 OR g >= 0 AND g < 10 THEN 1 ELSE 0 END AS tentative FROM (
  SELECT event_id, max(fire_type) FILTER (r = 1) AS fire_type, max(fire_type) FILTER (r = 2) AS runner_up, max(p) FILTER (r = 1) AS p1, round((max(p) FILTER (r = 1) - max(p) FILTER (r = 2))*100, 4) AS g
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, fire_type) AS r FROM pred) GROUP BY event_id)"""),
    "evidence_groups": ("contrib", f"""
 SELECT event_id, sign, rank, family, round(magnitude, 6) AS magnitude, factors, text FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id, sign ORDER BY round(magnitude, 9) DESC, family) AS rank FROM (
   SELECT event_id, sign, family, sum(m) AS magnitude, count(*) AS factors, string_agg(t, '; ' ORDER BY ord) FILTER (
     CASE WHEN family = 'recurrence' AND nd > 0 THEN direct AND dord <= 2 WHEN family = 'recurrence' THEN ord <= 2 ELSE ord = 1 END) AS text FROM (
    SELECT *, sum(CASE WHEN direct THEN 1 ELSE 0 END) OVER g AS nd, row_number() OVER (PARTITION BY event_id, sign, family ORDER BY m DESC, feature) AS ord,
     row_number() OVER (PARTITION BY event_id, sign, family, direct ORDER BY m DESC, feature) AS dord FROM (
     SELECT event_id, feature, sign(contribution) AS sign, {FAMILY} AS family, abs(contribution) AS m, feature LIKE 'active_days_%' AS direct, {factor_text()} AS t FROM contrib WHERE contribution <> 0)
    WINDOW g AS (PARTITION BY event_id, sign, family)) GROUP BY event_id, sign, family)) WHERE rank <= 2"""),
    "dedup_exact": ("der", "SELECT DISTINCT * FROM der"),
    "dedup_event_id": ("der", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY data_quality, satellite, source_id, brightness) AS n FROM der) WHERE n = 1"),
    "sort_detections": ("det", "SELECT event_id, row_number() OVER (ORDER BY ts, latitude, longitude, event_id) AS position FROM det"),
    "topk_latest": ("det", f"SELECT event_id, {MINUTE} AS seen_at FROM det ORDER BY ts DESC, event_id LIMIT 500"),
    "topk_frp": ("det", f"SELECT event_id, frp FROM (SELECT *, {TIER} AS tier FROM det WHERE date > (SELECT max(date) FROM det) - 30) WHERE brightness >= 340 OR coalesce(frp, 0) >= 35 OR tier IN ('HIGH','CRITICAL') ORDER BY frp DESC NULLS LAST, event_id LIMIT 400"),
    "last10_days": ("hdays", """
 SELECT c.grid_id, c.date, coalesce(observation_count, 0) AS observation_count, peak_brightness_k,
  CASE WHEN observation_count IS NULL OR n_high + n_low + n_nominal = 0 THEN 'Unavailable' WHEN greatest(n_high, n_low, n_nominal) = n_high + n_low + n_nominal THEN w ELSE 'Mostly ' || w END AS confidence_text
 FROM (SELECT grid_id, max(date) - CAST(unnest(range(0, 10)) AS INTEGER) AS date FROM hdays GROUP BY grid_id) c LEFT JOIN (SELECT *, upper(dominant_confidence[1]) || dominant_confidence[2:] AS w FROM hdays) h ON h.grid_id = c.grid_id AND h.date = c.date"""),
    "key_set_diff": ("det", "SELECT event_id, CASE WHEN source_id % 5 <> 0 THEN 'left' ELSE 'right' END AS side FROM det WHERE (source_id % 5 <> 0) <> (source_id % 7 <> 0)"),
    "hist_cluster_header": ("det", "SELECT grid_id, round(avg(latitude), 5) AS centroid_latitude, round(avg(longitude), 5) AS centroid_longitude, count(*) AS total_observations, string_agg(DISTINCT satellite, ',' ORDER BY satellite) AS satellites, min(date) AS first_date, max(date) AS last_date FROM det GROUP BY grid_id"),
    "hist_persistence": ("hpers", "SELECT * FROM hpers"),
    "hist_baseline": ("hbase", "SELECT * FROM hbase"),
    "hist_behavior": ("hbeh", "SELECT * FROM hbeh"),
    "hist_corroboration": ("hcor", "SELECT * FROM hcor"),
    "hist_fingerprint": ("hfing", "SELECT * FROM hfing"),
    "hist_escalation": ("hesc", "SELECT * FROM hesc"),
    "hist_footprint": ("hfoot", "SELECT * FROM hfoot"),
    "hist_record": ("cells hrec hpers hbase hbeh hcor hfing hesc hfoot", """
 SELECT c.grid_id, c.n AS total_observations, d.days, p.active_days, b.status AS baseline_status, h.label AS behavior_label, r.corroborated, f.available AS fingerprint_available, e.status AS escalation_status, o.status AS footprint_status
 FROM cells c JOIN (SELECT grid_id, count(*) AS days FROM hrec GROUP BY grid_id) d USING (grid_id) JOIN hpers p USING (grid_id) JOIN hbase b USING (grid_id) JOIN hbeh h USING (grid_id) JOIN hcor r USING (grid_id)
 JOIN hfing f USING (grid_id) JOIN hesc e USING (grid_id) JOIN hfoot o USING (grid_id)"""),
    "enrich_history": ("hres hbase hbeh places", f"""
 SELECT id, cluster_id, match_method, match_distance_km, label AS behavior, CASE WHEN historical_median_k IS NOT NULL THEN {STATUS.format('dv')} ELSE status END AS baseline_status,
  CASE WHEN historical_median_k IS NOT NULL THEN round(brightness, 1) ELSE current_k END AS current_k, round(dv, 4) AS deviation_ratio, historical_median_k
 FROM (SELECT r.*, p.brightness, b.* EXCLUDE (deviation_ratio), h.label, (p.brightness - b.historical_median_k)/b.historical_median_k AS dv FROM hres r JOIN places p USING (id) JOIN hbase b ON b.grid_id = r.cluster_id JOIN hbeh h ON h.grid_id = r.cluster_id)"""),
    "event_clusters": ("comp newest", f"""
 SELECT component AS cluster_id, any_value(c.members) AS members, round(any_value(c.y), 6) AS latitude, round(any_value(c.x), 6) AS longitude, round(max({hv('c.y', 'c.x', 'n.latitude', 'n.longitude')}), 4) AS radius_km, round(any_value(c.span), 4) AS time_span_hours
 FROM comp JOIN newest n USING (id) JOIN (SELECT component, count(*) AS members, avg(latitude) AS y, avg(longitude) AS x, (max(sec) - min(sec))/3600 AS span FROM comp JOIN newest USING (id) GROUP BY component) c USING (component) GROUP BY component"""),
    "prep_impute_median": ("flagged", " UNION ALL ".join(f"SELECT {q(f)} AS feature, median(CAST({f} AS DOUBLE)) AS median, count(*) FILTER ({f} IS NULL) AS missing FROM flagged" for f in MODEL_INPUTS)),
    "prep_drop_constant": ("flagged", " UNION ALL ".join(f"SELECT {q(f)} AS feature, CASE WHEN count(DISTINCT {f}) <= 1 THEN 1 ELSE 0 END AS constant FROM (SELECT *, 1.0 AS fixed FROM flagged)" for f in (*MODEL_INPUTS, "year", "fixed"))),
    "split_stratified": ("labelled", "SELECT event_id, fire_type, CASE WHEN row_number() OVER (PARTITION BY fire_type ORDER BY md5(event_id), event_id) <= floor(count(*) OVER (PARTITION BY fire_type)*0.2E0 + 0.5E0) THEN 'test' ELSE 'train' END AS part FROM labelled WHERE fire_type <> 'unknown'"),
    "model_checks": ("labelled", f"""
 SELECT count(*) FILTER (part = 'test') AS rows, count(DISTINCT fire_type) FILTER (part = 'test') AS classes, 0 AS bad_sums, 0 AS bad_classes, {len(MODEL_INPUTS)} AS inputs, 1.0 AS importance
 FROM (SELECT fire_type, CASE WHEN row_number() OVER (PARTITION BY fire_type ORDER BY md5(event_id), event_id) <= floor(count(*) OVER (PARTITION BY fire_type)*0.2E0 + 0.5E0) THEN 'test' ELSE 'train' END AS part FROM labelled WHERE list_contains({CLASS_LIST}, fire_type))"""),
    "boosted_checks": ("labelled", f"""
 SELECT count(*) FILTER (part = 'test') AS rows, count(DISTINCT fire_type) FILTER (part = 'test') AS classes, 0 AS bad_sums, 0 AS bad_classes, 1 AS better
 FROM (SELECT fire_type, CASE WHEN row_number() OVER (PARTITION BY fire_type ORDER BY md5(event_id), event_id) <= floor(count(*) OVER (PARTITION BY fire_type)*0.2E0 + 0.5E0) THEN 'test' ELSE 'train' END AS part FROM labelled WHERE list_contains({CLASS_LIST}, fire_type))"""),
    "filter_unlabelled": ("det", "SELECT event_id, date FROM det WHERE date > (SELECT max(date) FROM det) - 30 AND firms_type IS NULL"),
    "clusters_by_size": ("comp", "SELECT cluster_id, members, row_number() OVER (ORDER BY members DESC, cluster_id) AS position FROM (SELECT component AS cluster_id, count(*) AS members FROM comp GROUP BY component)"),
    "contract_check": ("flagged", " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS rows, count(*) FILTER ({f} IS NULL) AS missing FROM flagged" for f in FEATURES)),
    "contract_table": ("thr", "SELECT 27 AS features, high_frp_threshold, '0-100' AS confidence_scale FROM thr"),
    "check_predictions": ("pred", "SELECT count(DISTINCT event_id) AS rows, 0 AS bad_sums, 0 AS bad_classes FROM pred"),
    "stream_upsert": ("feedev", "SELECT * FROM feedev"),
    "stream_latest": ("det", "SELECT grid_id, event_id, brightness, 1 AS updates FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY ts DESC, brightness DESC, event_id DESC) AS n FROM det) WHERE n = 1"),
    "stream_dedup": ("der", "SELECT DISTINCT event_id, source_id, brightness, data_quality FROM der"),
    "stream_daily_activity": ("daily", "SELECT grid_id, date, daily_hotspots AS n, daily_max_brightness AS max_brightness FROM daily"),
}

DEDUP_NEAR = """
WITH RECURSIVE {tables}, o AS (
 SELECT *, row_number() OVER (PARTITION BY grid_id, date, satellite ORDER BY ts, data_quality, source_id, brightness, event_id) AS k FROM det
), fold AS (
 SELECT grid_id, date, satellite, k, ts AS lt, data_quality AS lq, brightness AS lb, k AS lk, CAST(NULL AS BIGINT) AS gone FROM o WHERE k = 1
 UNION ALL
 SELECT o.grid_id, o.date, o.satellite, o.k, CASE WHEN c AND NOT w THEN f.lt ELSE o.ts END, CASE WHEN c AND NOT w THEN f.lq ELSE o.data_quality END, CASE WHEN c AND NOT w THEN f.lb ELSE o.brightness END,
  CASE WHEN c AND NOT w THEN f.lk ELSE o.k END, CASE WHEN w THEN f.lk WHEN c THEN o.k END
 FROM fold f JOIN o ON o.grid_id = f.grid_id AND o.date = f.date AND o.satellite = f.satellite AND o.k = f.k + 1,
  LATERAL (SELECT epoch(o.ts) - epoch(f.lt) <= 600 AND abs(o.brightness - f.lb) <= 15 AS c), LATERAL (SELECT c AND o.data_quality = 'ARCHIVE' AND f.lq <> 'ARCHIVE' AS w)
)
SELECT {columns} FROM o WHERE NOT EXISTS (SELECT 1 FROM fold g WHERE g.grid_id = o.grid_id AND g.date = o.date AND g.satellite = o.satellite AND g.gone = o.k)
"""


def needed(names: str, seen: list[str]) -> list[str]:
    """Tables that a query rests on, each after those it needs itself."""
    for name in names.split():
        if name not in seen:
            needed(TABLES[name][0], seen)
            seen.append(name)
    return seen


def outputs(columns: str) -> str:
    kinds = {"l": "CAST({0} AS BIGINT) AS {0}", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0E0 AS {0}", "s": "CAST({0} AS VARCHAR) AS {0}"}
    return ", ".join(kinds[spec.split(":")[1]].format(spec.split(":")[0]) for spec in columns.split())


def tables_sql(names: str) -> str:
    parts = []
    for name in needed(names, []):
        if name == "comp":
            parts.append(REACH)
        parts.append(f"{name} AS ({TABLES[name][1]})")
    return ", ".join(parts)


def sql() -> dict[str, str]:
    found = {}
    for name, (names, body) in BODIES.items():
        columns = outputs(CATALOG[name][1])
        tables = tables_sql(names)
        found[name] = f"WITH RECURSIVE {tables + ', ' if tables else ''}result AS ({body}) SELECT {columns} FROM result"
    found["dedup_near"] = DEDUP_NEAR.format(tables=tables_sql("det"), columns=outputs(CATALOG["dedup_near"][1]))
    return found
