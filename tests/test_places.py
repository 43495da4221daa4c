"""Searches by place: rows that share a place are met once, with the results of all pairs."""

import math
import random

from emberfield.operators import persistence, spatial


def km_between(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def joined_rows(spark, run):
    """Rows that joins put out while ``run`` writes its result, the most of any one."""
    plans = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    before = plans.stageList(None, False, False, none, None).size()
    run().write.format("noop").mode("overwrite").save()
    stages = plans.stageList(None, False, False, none, None)
    return max(stages.apply(i).shuffleWriteRecords() for i in range(stages.size() - before))


def placed(n, places, seed):
    rng = random.Random(seed)
    spots = [(round(20 + rng.random() * 0.6, 4), round(80 + rng.random() * 0.6, 4)) for _ in range(places)]
    return [(f"e{i}", *rng.choice(spots), float(rng.randrange(300, 320)), f"2024-01-{rng.randrange(1, 20):02d}") for i in range(n)]


def test_strongest_in_box_by_place(spark):
    det, centres = placed(400, 60, 1), [(i, *r[1:3]) for i, r in enumerate(placed(120, 40, 2))]
    df = spark.createDataFrame(det, "event_id string, latitude double, longitude double, brightness double, date string")
    asked = spark.createDataFrame(centres, "id long, latitude double, longitude double")
    got = {r["id"]: (r["event_id"], r["brightness"]) for r in spatial.strongest_in_box(asked, df).collect()}
    want = {}
    for i, y, x in centres:
        near = [r for r in det if abs(r[1] - y) <= 0.2 and abs(r[2] - x) <= 0.2]
        if near:
            best = min(near, key=lambda r: (-r[3], r[0]))
            want[i] = (best[0], best[3])
    assert got == want


def test_nearby_by_place(spark):
    det = placed(500, 50, 3)
    df = spark.createDataFrame(det, "id string, latitude double, longitude double, brightness double, date string")
    got = {r["id"]: (r["observations"], r["unique_days"]) for r in persistence.nearby(df, df, km=5.0).collect()}
    want = {}
    for a in det:
        near = [b for b in det if km_between(a[1:3], b[1:3]) <= 5.0]
        want[a[0]] = (len(near), len({b[4] for b in near}))
    assert got == want


def test_what_is_shuffled_grows_with_places(spark):
    det = spark.createDataFrame(placed(6000, 30, 4), "event_id string, latitude double, longitude double, brightness double, date string")
    det = det.repartition(2)
    centres = det.selectExpr("event_id as id", "latitude", "longitude")
    assert joined_rows(spark, lambda: spatial.strongest_in_box(centres, det)) <= 12_000
    assert joined_rows(spark, lambda: persistence.nearby(centres, det, km=5.0)) <= 12_000
