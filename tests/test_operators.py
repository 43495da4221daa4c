"""Rules on small literal tables: window edges, duplicate chains, ties, missing values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield import schemas
from emberfield.functions import detections as d
from emberfield.functions import geo
from emberfield.operators import clean, clusters, history, labels, persistence, quantiles, scoring, serving, spatial
from emberfield.streaming import ingest


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_prior_window_includes_the_seventh_day_only(spark):
    daily = spark.createDataFrame([(1, day(n), k) for n, k in ((0, 5), (1, 7), (8, 1))], "grid_id long, date date, daily_hotspots long")
    got = {r["date"]: (r["hotspot_count_7d"], r["active_days_7d"]) for r in persistence.prior_activity(daily).collect()}
    assert got[day(8)] == (7, 1)  # d-7 in, d-8 out, d itself out
    assert got[day(0)] == (0, 0)


def detections(spark, rows):
    schema = "grid_id long, date date, satellite string, timestamp timestamp, data_quality string, source_id long, brightness double, event_id string"
    start = dt.datetime(2024, 1, 1, 0, 0)
    return spark.createDataFrame(
        [(1, day(0), "N20", start + dt.timedelta(minutes=m), q, i, k, f"e{i}") for i, (m, q, k) in enumerate(rows)], schema
    )


def test_near_duplicates_follow_the_last_kept_row(spark):
    chain = detections(spark, [(0, "NRT", 300.0), (9, "NRT", 300.0), (18, "NRT", 300.0), (19, "NRT", 300.0)])
    assert rows_of(clean.dedup_near(chain), "source_id") == [(0,), (2,)]
    swap = detections(spark, [(0, "NRT", 300.0), (4, "ARCHIVE", 305.0), (8, "NRT", 310.0)])
    assert rows_of(clean.dedup_near(swap), "source_id") == [(1,)]
    unknown = detections(spark, [(0, "NRT", None), (1, "NRT", 300.0)])
    assert rows_of(clean.dedup_near(unknown), "source_id") == [(0,), (1,)]


def test_nearest_distance_widens_and_leaves_empty_categories_null(spark):
    places = spark.createDataFrame([(1, 20.0, 80.0), (2, 30.0, 70.0)], "id long, latitude double, longitude double")
    points = spark.createDataFrame([("gas", 20.1, 80.0), ("gas", 20.0, 81.0), ("mining", 10.0, 95.0)], "category string, latitude double, longitude double")
    got = {r["id"]: r for r in spatial.nearest_distance(places, points, ("gas", "mining", "industrial")).collect()}
    km = lambda a, b, x, y: spark.range(1).select(geo.haversine(*map(F.lit, (a, b, x, y)))).first()[0]
    assert got[1]["distance_to_gas_km"] == pytest.approx(km(20.0, 80.0, 20.1, 80.0))
    assert got[2]["distance_to_gas_km"] == pytest.approx(min(km(30.0, 70.0, 20.1, 80.0), km(30.0, 70.0, 20.0, 81.0)))
    assert got[1]["distance_to_mining_km"] == pytest.approx(km(20.0, 80.0, 10.0, 95.0))
    assert got[1]["distance_to_industrial_km"] is None


def test_bucket_join_equals_brute_force_near_the_poles_and_the_equator(spark):
    pts = [(i, lat, lon) for i, (lat, lon) in enumerate((a, b) for a in (-0.01, 0.0, 0.02, 60.0, 60.03, 84.9) for b in (10.0, 10.02, 10.05))]
    df = spark.createDataFrame(pts, "id long, latitude double, longitude double")
    got = rows_of(spatial.bucket_join(df, df, 3.0), "id", "right_id")
    a, b = df.alias("a"), df.select(*(F.col(c).alias(f"right_{c}") for c in df.columns))
    near = geo.haversine(F.col("latitude"), F.col("longitude"), F.col("right_latitude"), F.col("right_longitude")) <= 3.0
    assert got == rows_of(a.crossJoin(b).filter(near), "id", "right_id")


def test_wildfire_needs_known_distances(spark):
    schema = (
        "near_gas_1km int, near_mining_2km int, near_industrial_1km int, active_days_30d int, persistent_activity int, low_persistence_flag int, month int, "
        "distance_to_industrial_km double, distance_to_mining_km double, distance_to_gas_km double"
    )
    df = spark.createDataFrame([(0, 0, 0, 9, 1, 0, 7, 5.0, 5.0, 5.0), (0, 0, 0, 9, 1, 0, 7, None, 5.0, 5.0), (1, 1, 1, 9, 1, 0, 7, 0.1, 0.1, 0.1)], schema)
    assert [r["fire_type"] for r in labels.label_fire_type(df).collect()] == ["wildfire", "unknown", "gas_flare"]


def test_sparse_cell_without_recurrence(spark):
    df = spark.createDataFrame([(1, 3, 1, None), (2, 2, 1, None), (3, 6, 20, 1.0), (4, 6, 6, 2.5)], "grid_id long, total long, active_days long, trend_ratio double")
    got = dict(rows_of(history.behavior_of(df), "grid_id", "label"))
    assert got == {1: "ISOLATED_TRANSIENT_DETECTION", 2: "ISOLATED_TRANSIENT_DETECTION", 3: "PERSISTENT_SOURCE", 4: "RECENT_ESCALATION"}


def test_thirty_dates_not_thirty_one(spark):
    det = spark.createDataFrame([(1, day(0)), (1, day(1)), (1, day(30))], "grid_id long, date date")
    r = history.persistence(det).first()
    assert (r["active_days"], r["longest_streak_days"], r["current_streak_days"]) == (2, 1, 1)


def test_times_and_confidence(spark):
    df = spark.createDataFrame([("13.0", "H"), ("905", "nominal"), ("2561", "x"), (" 7 ", "72"), (None, None)], "t string, c string")
    got = df.select(d.hhmm(F.col("t")), d.confidence_code(F.col("c"), "serving"), d.confidence_code(F.col("c"), "training")).collect()
    assert [tuple(r) for r in got] == [("0013", 90.0, 100.0), ("0905", 60.0, 50.0), (None, 0.0, None), ("0007", 72.0, None), (None, 0.0, None)]


def test_messy_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Latitude, bright_TI4 ,acq_date,acq_time,frp,type\n10.5,300,2024-01-02,905,bad,2\n,x,nope,13.0,NaN,\n")
    (tmp_path / "b.csv").write_text("latitude,brightness,acq_date\n11,301,2024-01-03\n")
    from emberfield.sources.files import read_detections

    got = read_detections(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert got.schema.names == schemas.STANDARD.names
    assert sorted((r["latitude"] or 0, r["brightness"] or 0, r["frp"], r["firms_type"]) for r in got.collect()) == [(0, 0, None, None), (10.5, 300.0, None, 2), (11.0, 301.0, None, None)]


def test_required_columns(spark):
    df = spark.createDataFrame([(1, "a")], "brightness int, frp string")
    with pytest.raises(ValueError, match="missing columns: x"):
        schemas.require_columns(df, ["brightness", "x"])
    with pytest.raises(ValueError, match="not numeric: frp"):
        schemas.require_contract(df, ["brightness", "frp"])


def test_unique_match_by_place_time_and_satellite(spark):
    point = "id string, latitude double, longitude double, date string, time string, satellite string"
    row = "latitude double, longitude double, date string, time string, satellite string, event_id string, fire_type string"
    points = spark.createDataFrame(
        [("a", 20.12345, 77.12345, "d", "0800", "N20"), ("b", 20.12345, 77.12345, "d", "0800", "N21"), ("c", 20.12345, 77.12345, "d", "0801", "N20"), ("e", 1.0, 1.0, "d", "0800", "N20")],
        point,
    )
    rows = spark.createDataFrame(
        [(20.123451, 77.12345, "d", "0800", "N20", "s", "wildfire"), (1.0, 1.0, "d", "0800", "N20", "t", "x"), (1.0, 1.0, "d", "0800", "N20", "u", "x")], row
    )
    got = {r["id"]: (r["status"], r["event_id"], r["fire_type"]) for r in serving.match_unique(points, rows).collect()}
    assert got == {"a": ("matched", "s", "wildfire"), "b": ("unmatched", None, None), "c": ("unmatched", None, None), "e": ("ambiguous", None, None)}


def test_upsert_changes_listed_columns_only(spark):
    schema = "id string, latitude double, brightness double, confidence int, risk string, classification string, source string, features string"
    old = spark.createDataFrame([("a", 1.0, 300.0, 50, "LOW", "x", "s", "{}"), ("b", 2.0, 300.0, 50, "LOW", "x", "s", "{}")], schema)
    new = spark.createDataFrame([("a", 9.0, 310.0, 60, "HIGH", "y", "t", "{}"), ("c", 3.0, 320.0, 60, "HIGH", "y", "t", "{}")], schema)
    got = rows_of(serving.upsert_events(old, new), "id", "latitude", "brightness", "risk")
    assert got == [("a", 1.0, 310.0, "HIGH"), ("b", 2.0, 300.0, "LOW"), ("c", 3.0, 320.0, "HIGH")]


VALID = dict(
    latitude=22.35, longitude=69.85, timestamp=dt.datetime(2026, 9, 10), brightness=330.0, bright_t31=300.0, frp=15.0, confidence_score=50.0, daynight="N",
    active_days_7d=2, active_days_30d=5, hotspot_count_7d=2, hotspot_count_30d=5, daily_total_frp=15.0, daily_max_brightness=330.0, daily_mean_confidence=50.0,
)


@pytest.mark.parametrize(
    ("change", "rules"),
    [
        ({}, []), ({"frp": 0.0, "daily_total_frp": 0.0}, []), ({"brightness": 900.0}, ["brightness", "daily_max_brightness"]),
        ({"daynight": "X"}, ["daynight"]), ({"active_days_30d": 1}, ["window_days"]), ({"latitude": float("nan")}, ["latitude"]),
        ({"hotspot_count_7d": 0}, ["window_counts", "window_zeros"]), ({"daily_total_frp": 1.0}, ["daily_total_frp"]),
    ],
)
def test_impossible_observations(spark, change, rules):
    got = scoring.validate(spark.createDataFrame([VALID | change])).first()["violations"]
    assert got == rules


def test_clusters_link_transitively_and_missing_times_count(spark):
    ev = spark.createDataFrame(
        [("a", 10.0, 80.0, 0), ("b", 10.2, 80.0, 100), ("c", 10.4, 80.0, None), ("d", 40.0, 80.0, 0), ("d", 41.0, 80.0, 0), ("e", 95.0, 80.0, 0)],
        "id string, latitude double, longitude double, at long",
    )
    got = rows_of(clusters.event_clusters(ev), "cluster_id", "members")
    assert got == [("a", 3), ("d", 1)]


def test_rank_ties_are_ordered(spark):
    df = spark.createDataFrame([("a", 2), ("b", 1)], "event_id string, x int")
    kept = clean.keep_first(df.withColumn("k", F.lit(1)), ["k"], ["x", "event_id"])
    assert kept.first()["event_id"] == "b"


def test_exact_percentile_equals_numpy_on_both_sides_of_the_bracket(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40_000):
        values = np.round(rng.lognormal(size=n), 3)
        df = spark.createDataFrame([("f", float(v)) for v in values] + [("f", None)], "feature string, value double")
        for share in (0.0, 0.5, 0.9, 1.0):
            row = quantiles.exact_percentile(df, share).first()
            assert row["n"] == n and row["percentile"] == pytest.approx(np.quantile(values, share), abs=1e-12)
    assert labels.high_frp_threshold(spark.createDataFrame([], "frp double")).first()[0] is None


def globe(rng, n):
    return [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, n), rng.uniform(-180, 180, n), strict=True)]


def test_nearest_distance_equals_brute_force_over_the_globe(spark):
    rng = np.random.default_rng(5)
    spots = [("gas", *p) for p in globe(rng, 60)] + [("gas", 90.0, 0.0), ("gas", -3.0, 180.0), ("mine", 10.0, 10.0), ("mine", None, 1.0)]
    spots += [("gas", 50.0 + float(a), 8.0 + float(b)) for a, b in rng.uniform(0, 0.3, (200, 2))]
    places = [(i, *p) for i, p in enumerate(globe(rng, 80))] + [(80, -3.0, -179.99), (81, None, 4.0)]
    places += [(100 + i, 50.0 + float(a), 8.0 + float(b)) for i, (a, b) in enumerate(rng.uniform(-0.1, 0.4, (60, 2)))]
    places = spark.createDataFrame(places, "id long, latitude double, longitude double")
    spots = spark.createDataFrame(spots, "category string, latitude double, longitude double")
    every = places.crossJoin(spots.select("category", F.col("latitude").alias("y"), F.col("longitude").alias("x")))
    km = F.min(geo.haversine("latitude", "longitude", F.col("y"), F.col("x"))).alias("km")
    want = {(r["category"], r["id"]): r["km"] for r in every.filter("id <> 81").groupBy("category", "id").agg(km).collect()}
    want |= {("gas", 81): None, ("mine", 81): None}  # a place without coordinates
    for depth in (None, 0, 5):
        got = spatial.nearest_distance(places, spots, ("gas", "mine", "none"), depth).collect()
        for c in ("gas", "mine"):
            assert {r["id"]: r[f"distance_to_{c}_km"] for r in got} == {i: k and pytest.approx(k) for (x, i), k in want.items() if x == c}
        assert all(r["distance_to_none_km"] is None for r in got) and len(got) == 142
    assert want["gas", 80] < 2  # across the 180th meridian
    assert spatial.nearest_distance(places, spots.limit(0), ("gas",)).filter("distance_to_gas_km is null").count() == 142


def test_a_place_meets_few_spots_however_many_there_are(spark):
    rng = np.random.default_rng(6)
    places = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(20, 22, (50, 2)))], "id long, latitude double, longitude double")
    for n in (100, 10_000):
        spots = spark.createDataFrame([("gas", *map(float, p)) for p in rng.uniform(20, 22, (n, 2))], "category string, latitude double, longitude double")
        depth = spatial.depth_for(spots)
        cells = spatial.nearest_cells(places, spots, ("gas",), depth)
        held = spots.select("category", spatial._cell(spatial.LEVELS[depth]).alias("cell"))
        pairs = cells.join(held, ["category", "cell"]).count() / 50
        assert pairs < 100, (n, depth, pairs)


def test_spread_equals_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(1, day(0), round(float(a), 3), round(float(b), 3)) for a, b in rng.uniform(20.0, 20.1, (60, 2))] + [(2, day(0), 20.0, 80.0), (3, day(0), 1.0, 1.0), (3, day(0), 1.0, 1.0)]
    det = spark.createDataFrame(rows, "grid_id long, date date, latitude double, longitude double")
    other = det.select("grid_id", F.col("latitude").alias("y"), F.col("longitude").alias("x"))
    km = geo.haversine("latitude", "longitude", F.col("y"), F.col("x"), geo.HISTORY_RADIUS)
    want = dict(det.join(other, "grid_id").groupBy("grid_id").agg(F.max(km)).collect()) | {2: None}
    assert dict(history.daily_spread(det).select("grid_id", "estimated_spread_km").collect()) == pytest.approx(want)


def test_near_duplicates_do_not_reach_over_a_gap(spark):
    chain = detections(spark, [(m, "NRT", 300.0) for m in (0, 10, 20, 31, 41, 60, 61)])
    assert rows_of(clean.dedup_near(chain), "source_id") == [(0,), (2,), (3,), (5,)]


def test_exactly_one_fails_on_unmatched_points(spark):
    schema = "id string, status string, event_id string, fire_type string"
    good = spark.createDataFrame([("a", "matched", "e", "wildfire")], schema)
    assert serving.exactly_one(good).count() == 1
    with pytest.raises(Exception, match="no single row for point b: ambiguous"):
        serving.exactly_one(good.unionByName(spark.createDataFrame([("b", "ambiguous", None, None)], schema))).collect()


EVENT = "id string, detected_at timestamp, latitude double, brightness double"


def test_upsert_takes_the_last_of_several_updates(spark):
    at = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", at, 1.0, 300.0)], EVENT)
    new = spark.createDataFrame([("a", at + dt.timedelta(hours=h), 9.0, 310.0 + h) for h in (2, 1)] + [("b", at, 3.0, k) for k in (5.0, 6.0)], EVENT)
    assert rows_of(serving.upsert_events(old, new), "id", "latitude", "brightness") == [("a", 1.0, 312.0), ("b", 3.0, 6.0)]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    put = lambda *rows: spark.createDataFrame([(i, at, lat, k) for i, lat, k in rows], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.createDataFrame([], EVENT).schema
    run = lambda: rows_of(
        ingest.stream_upsert(spark, str(tmp_path / "in"), schema, lambda df: df, "id", ("brightness",), folder=str(tmp_path / "state")), "id", "latitude", "brightness"
    )
    put(("a", 1.0, 300.0), ("a", 1.0, 301.0))
    assert run() == [("a", 1.0, 301.0)]
    assert run() == [("a", 1.0, 301.0)]  # nothing new
    put(("a", 7.0, 290.0), ("b", 2.0, 310.0))
    assert run() == [("a", 1.0, 290.0), ("b", 2.0, 310.0)]


def test_unlabelled_rows_of_the_window(spark):
    det = spark.createDataFrame([(1, day(0), None), (2, day(30), None), (3, day(30), 2), (4, day(1), None)], "id long, date date, firms_type long")
    assert rows_of(persistence.unlabelled(det), "id") == [(2,), (4,)]
