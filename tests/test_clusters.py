"""Components on hard graphs, and clusters by classes against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberfield.operators import clusters
from emberfield.operators.components import components

EVENT = "id string, latitude double, longitude double, at long"


def least_reachable(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(5000)], [(0, i) for i in range(1, 3000)], [(3000, i) for i in range(3000)],
    [(i, i // 2) for i in range(2, 2000)], [((i * 7919) % 3001, ((i + 1) * 7919) % 3001) for i in range(3000)], [], [(1, 1), (2, 1), (1, 2)],
], ids=["chain", "hub", "last hub", "tree", "shuffled chain", "empty", "self"])
def test_components_settle_in_few_rounds(spark, links):
    df = spark.createDataFrame(links, "u long, v long")
    got = {r["node"]: r["component"] for r in components(df, rounds=15).collect()}
    assert got == {x: c for x, c in least_reachable(links).items() if x != c}


def km_between(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def linked(a, b, km, hours):
    return km_between(a, b) <= km and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= hours * 3600)


def by_all_pairs(events, km=25.0, hours=168.0):
    links = [(a[0], b[0]) for i, a in enumerate(events) for b in events[i:] if linked(a, b, km, hours)]
    return least_reachable(links)


def scattered(rng, n, lat, lon, wide, times):
    wrap = lambda x: (x + 180) % 360 - 180
    return [(lat + rng.uniform(-wide, wide), wrap(lon + rng.uniform(-wide, wide)), rng.choice(times)) for _ in range(n)]


@pytest.mark.parametrize(("lat", "lon", "wide"), [(10, 80, 1.5), (0, 0, 1), (62, 179.9, 2), (-85, -179.5, 3), (89.5, 10, 0.4)])
def test_classes_give_the_clusters_of_all_pairs(spark, lat, lon, wide):
    rng = random.Random(lat)
    hour = 3600
    times = [None, *(rng.randrange(0, 60 * 24) * hour for _ in range(12)), 0, 168 * hour, 336 * hour]
    places = scattered(rng, 150, lat, lon, wide, times) + scattered(rng, 120, lat, lon, 0.08, times)  # and one dense place
    events = [(f"e{i:03d}", min(90.0, y), x, t) for i, (y, x, t) in enumerate(places)]
    events += [(f"f{i}", *events[i][1:]) for i in range(20)]
    want = by_all_pairs(events)
    got = clusters.membership(spark.createDataFrame(events, EVENT))
    assert {r["id"]: r["component"] for r in got.collect()} == want
    assert lat == 89.5 or 1 < len(set(want.values())) < len(events)


def test_links_are_by_classes_not_by_pairs(spark):
    rng = random.Random(4)
    # Two thousand events in two dense places: two million pairs, some classes.
    events = [(f"e{i:04d}", 10 + (i % 2) * 0.2 + rng.uniform(0, 0.1), 80 + rng.uniform(0, 0.1), rng.randrange(300 * 3600)) for i in range(2000)]
    held, links = clusters.class_links(spark.createDataFrame(events, EVENT))
    assert held.count() <= 20 and links.count() <= 60
    got = clusters.membership(spark.createDataFrame(events, EVENT)).select("component").distinct().count()
    assert got == len(set(by_all_pairs(events).values()))


def test_bounds_never_contradict_pairs(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        lat, lon = rng.uniform(-89, 89), rng.uniform(-180, 180)
        box = [(lat + rng.uniform(0, 0.2), lon + rng.uniform(0, 0.2), rng.randrange(10**6)) for _ in range(3)]
        off = (rng.uniform(-0.3, 0.3), rng.uniform(-0.4, 0.4))
        other = [(y + off[0], (x + off[1] + 180) % 360 - 180, t + rng.randrange(-(10**6), 10**6)) for y, x, t in box]
        if max(o[1] for o in other) - min(o[1] for o in other) < 180:
            rows.append((box, other))
    bounds = lambda b: tuple(f(p[k] for p in b) for k in (0, 1, 2) for f in (min, max))
    kind = "struct<y0:double,y1:double,x0:double,x1:double,s0:long,s1:long>"
    df = spark.createDataFrame([(i, bounds(a), bounds(b)) for i, (a, b) in enumerate(rows)], f"i int, l {kind}, r {kind}")
    told = {r["i"]: r["near"] for r in df.select("i", clusters._nearness(25.0, 168.0).alias("near")).collect()}
    assert {-1, 0, 1} <= set(told.values())
    for i, (a, b) in enumerate(rows):
        pairs = [linked((0, *p), (0, *q), 25.0, 168.0) for p in a for q in b]
        assert told[i] == 0 or all(x == (told[i] == 1) for x in pairs)


def test_empty_and_single_events(spark):
    assert clusters.event_clusters(spark.createDataFrame([], EVENT)).count() == 0
    rows = clusters.event_clusters(spark.createDataFrame([("a", 1.0, 2.0, None)], EVENT)).collect()
    assert [(r["cluster_id"], r["members"], r["time_span_hours"]) for r in rows] == [("a", 1, 0.0)]
    assert clusters.membership(spark.createDataFrame([("a", 1.0, 2.0, 5)], EVENT)).select(F.col("component")).first()[0] == "a"


def test_edges_meet_by_time_and_once(spark):
    rng = random.Random(6)
    hour = 3600
    times = [None, *(rng.randrange(-20 * 24, 60 * 24) * hour for _ in range(30)), 0, 168 * hour, 336 * hour]
    places = scattered(rng, 120, 10, 179.9, 0.4, times)
    events = [(f"e{rng.randrange(10**6):06d}-{i}", *p) for i, p in enumerate(places)]
    got = clusters.event_edges(spark.createDataFrame(events, EVENT))
    pairs = sorted((r["id_a"], r["id_b"]) for r in got.collect())
    assert pairs == sorted((min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(events) for b in events[i + 1 :] if linked(a, b, 25.0, 168.0))

    # Ten slots of two hundred events at one place: pairs of one slot and the next meet, not all of the cell.
    events = [(f"e{i:04d}", 10.0, 80.0, (i % 10) * 336 * hour) for i in range(2000)]
    df = spark.createDataFrame(events, EVENT)
    plan = clusters.event_edges(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" in plan[plan.index("Join Inner") : plan.index("\n", plan.index("Join Inner"))]
    assert clusters.event_edges(df).count() == 10 * 200 * 199 // 2


def test_connected_classes_are_not_compared_again(spark, monkeypatch):
    # A dense square: every class is next to others by bounds that leave it open, and touching parts connect all.
    rng = random.Random(7)
    events = [(f"e{i:04d}", 10 + rng.uniform(0, 0.8), 80 + rng.uniform(0, 0.8), rng.randrange(300 * 3600)) for i in range(4000)]
    names, kept = [], clusters.written
    monkeypatch.setattr(clusters, "written", lambda df, name: names.append(name) or kept(df, name))
    got = clusters.membership(spark.createDataFrame(events, EVENT)).select("component").distinct().count()
    assert got == 1 and "decided" not in names


@pytest.mark.parametrize(("lat", "lon", "wide"), [(10, 80, 1.5), (0, 0, 1), (62, 179.9, 2), (-85, -179.5, 3), (89.5, 10, 0.4)])
def test_edges_by_blocks_and_shares(spark, lat, lon, wide):
    rng = random.Random(lat + 1)
    hour = 3600
    times = [None, *(rng.randrange(-30 * 24, 60 * 24) * hour for _ in range(20)), 0, 168 * hour, 336 * hour]
    places = scattered(rng, 120, lat, lon, wide, times) + scattered(rng, 80, lat, lon, 0.08, times)
    events = [(f"e{rng.randrange(10**6):06d}-{i}", min(90.0, y), x, t) for i, (y, x, t) in enumerate(places)]
    events += [(f"d{i}", *events[i][1:]) for i in range(20)]
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(events) for b in events[i + 1 :] if linked(a, b, 25.0, 168.0))
    df = spark.createDataFrame(events, EVENT)
    for sizes in ({}, {"most": 3, "wide": 2, "long": 2, "share": 10}):
        assert sorted((r["id_a"], r["id_b"]) for r in clusters.event_edges(df, **sizes).collect()) == want


def test_edges_shuffle_a_few_copies_of_an_event(spark):
    rng = random.Random(8)
    events = [(f"e{i:05d}", 10 + rng.uniform(0, 2), 80 + rng.uniform(0, 2), rng.randrange(28 * 24 * 3600)) for i in range(8000)]
    df = spark.createDataFrame(events, EVENT).repartition(2)
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def most_shuffled(run):
        """Bytes that the stage writes which writes most, by ids of stages, as the list itself forgets old ones."""
        stages = lambda: [s.apply(i) for s in [store.stageList(None, False, False, none, None)] for i in range(s.size())]
        last = max((s.stageId() for s in stages()), default=-1)
        run().write.format("noop").mode("overwrite").save()
        return max(s.shuffleWriteBytes() for s in stages() if s.stageId() > last)

    once = most_shuffled(lambda: df.repartition(4, "id"))
    assert most_shuffled(lambda: clusters.event_edges(df)) <= 6 * once
