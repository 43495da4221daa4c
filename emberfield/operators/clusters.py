"""Single-linkage clusters of events in space and time."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RADIUS, box_bounds, degrees_of, haversine, haversine_of
from ..sources.files import written
from .clean import keep_first
from .components import components
from .spatial import box_cells, lon_degrees


def usable(events: DataFrame) -> DataFrame:
    """Events with valid coordinates, one per id.  Columns id, latitude, longitude, at (seconds, may be null)."""
    ok = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & F.col("id").isNotNull()
    return keep_first(events.filter(ok), ["id"], ["at", "latitude", "longitude"])


def classes(rows: DataFrame, km: float, hours: float) -> DataFrame:
    """Adds a, b, t: cells of space and time so small that all events of one are linked; t is null without a time.

    The diagonal of a cell is ``km`` at the equator and shorter elsewhere.
    """
    size, _ = degrees_of(km * (1 - 1e-9) / math.sqrt(2))
    cell = {"a": F.floor(F.col("latitude") / size), "b": F.floor(F.col("longitude") / size)}
    return rows.withColumns(cell | {"t": F.floor(F.col("at") / (hours * 3600))})


def _boxes(rows: DataFrame, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """One row per key: smallest id, count and bounds in space and time."""
    ends = {"y": "latitude", "x": "longitude", "s": "at"}
    return rows.groupBy(*keys).agg(
        F.min("id").alias("id"), F.count("*").alias("n"),
        *(f(c).alias(f"{k}{end}") for k, c in ends.items() for end, f in ((0, F.min), (1, F.max))), *more,
    )


def _nearness(km: float, hours: float, left: str = "l", right: str = "r") -> Column:
    """1 if all events of two boxes are linked, -1 if none can be, else 0."""
    l, r = ({c: F.col(f"{side}.{c}") for c in ("y0", "y1", "x0", "x1", "s0", "s1")} for side in (left, right))
    least, most = box_bounds(l, r)
    gap, span = F.greatest(r["s0"] - l["s1"], l["s0"] - r["s1"]), F.greatest(r["s1"] - l["s0"], l["s1"] - r["s0"])
    apart = (least > km * (1 + 1e-9)) | F.coalesce(gap > hours * 3600, F.lit(False))
    within = (most < km * (1 - 1e-9)) & F.coalesce(span <= hours * 3600, F.lit(True))
    return F.when(apart, -1).when(within, 1).otherwise(0)


_BOX = ("id", "n", "y0", "y1", "x0", "x1", "s0", "s1")


def _reached(km: float, size: float) -> Column:
    """Array of the cells of a size that hold whatever may be within ``km`` of a box."""
    reach, _ = degrees_of(km)
    y, x = (F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2
    far = F.when(F.abs("y0") > F.abs("y1"), F.col("y0")).otherwise(F.col("y1"))
    wide = (F.col("x1") - F.col("x0")) / 2 + lon_degrees(far, km, RADIUS)
    return box_cells(y, x, size, ((F.col("y1") - F.col("y0")) / 2 + reach) * (1 + 1e-9), wide * (1 + 1e-9))


def _neighbours(boxes: DataFrame, km: float) -> DataFrame:
    """Pairs (l, r) of classes that may hold linked events, each once; a class without a time meets all times."""
    size, _ = degrees_of(km * (1 - 1e-9) / math.sqrt(2))
    left = boxes.select(F.struct(*_BOX, "t").alias("l"), F.explode(_reached(km, size)).alias("cell"))
    right = boxes.select(F.struct(*_BOX, "t").alias("r"), F.struct("a", "b").alias("cell"))
    steps = F.explode(F.array(*(F.col("l.t") + i for i in (-1, 0, 1)))).alias("t")
    timed = left.filter("l.t is not null").select("l", "cell", steps)
    both = timed.join(right.filter("r.t is not null").select("r", "cell", F.col("r.t").alias("t")).hint("merge"), ["cell", "t"]).filter("l.id < r.id")
    untimed = left.filter("l.t is null").join(right.hint("merge"), "cell").filter("r.t is not null or l.id < r.id")
    return both.select("l", "r").unionAll(untimed.select("l", "r"))


def _blocks(events: DataFrame, km: float, hours: float, most: int) -> DataFrame:
    """Events of a class in arrays of at most ``most``, in the order of time, with their bounds; places also in radians."""
    rows = classes(events.select("id", "latitude", "longitude", "at"), km, hours)
    place = F.row_number().over(Window.partitionBy("a", "b", "t").orderBy("at", "id"))
    rows = rows.withColumn("part", F.floor((place - 1) / most))
    y = F.radians("latitude")
    event = F.struct("id", y.alias("y"), F.radians("longitude").alias("x"), F.cos(y).alias("cos"), "at")
    return _boxes(rows, "a", "b", "t", "part", more=(F.collect_list(event).alias("events"),))


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], share: int) -> DataFrame:
    """Blocks of both sides that share the keys.  Where these have more than ``share`` events, right ones are dealt out."""
    # At most one row per ``share`` events.
    crowded = F.broadcast(right.groupBy(*keys).agg(F.ceil(F.sum("r.n") / share).cast("int").alias("shares")).filter("shares > 1"))
    shares = F.coalesce("shares", F.lit(1))
    left = left.join(crowded, keys, "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
    right = right.join(crowded, keys, "left").withColumn("share", F.pmod(F.xxhash64("r"), shares).cast("int")).drop("shares")
    return left.join(right.hint("merge"), [*keys, "share"])


def event_edges(
    events: DataFrame, km: float = 25.0, hours: float = 168.0, most: int = 512, wide: int = 8, long: int = 4, share: int = 200_000
) -> DataFrame:
    """Pairs (id_a < id_b) within the distance and, where both times are known, within the hours.

    Events of a class travel together, in blocks of at most ``most``.  A block stays in its cell, ``wide``
    classes across and ``long`` slots of time, and is sent to the cells that it can reach, in time only
    onwards: some three copies, where classes of their own would take twenty.  Bounds tell which blocks
    can hold pairs, and only these are opened; each two blocks meet once, by their order.  A
    crowded cell is dealt out in shares.  Events without a time meet all of their cells.
    What is shuffled grows with the events; the result itself grows with the square of the density.
    """
    size, _ = degrees_of(km * (1 - 1e-9) / math.sqrt(2))
    reach, _ = degrees_of(km)
    blocks = written(_blocks(events, km, hours, most), "blocks")
    block = F.struct("t", "a", "b", "part", *_BOX)
    held = blocks.select(
        block.alias("r"), F.col("events").alias("right_events"),
        F.struct(F.floor(F.col("a") / wide).alias("a"), F.floor(F.col("b") / wide).alias("b")).alias("cell"), F.floor(F.col("t") / long).alias("slots"),
    )
    sent = blocks.select(block.alias("l"), "events", F.explode(_reached(km, size * wide)).alias("cell"))
    slots = F.array_distinct(F.array(*(F.floor((F.col("l.t") + i) / long) for i in (0, 1))))
    timed = sent.filter("l.t is not null").withColumn("slots", F.explode(slots))
    met = [_dealt(timed, held.filter("r.t is not null"), ["cell", "slots"], share)]
    if blocks.filter("t is null").limit(1).count():
        met.append(_dealt(sent.filter("l.t is null"), held.drop("slots"), ["cell"], share))

    def opened(met: DataFrame) -> DataFrame:
        l, r = ({c: F.col(f"{side}.{c}") for c in ("t", "a", "b", "part", *_BOX)} for side in ("l", "r"))
        # Cheap tests first.  Without a time, the left one is before all that have one.
        same_slot, within = l["t"].eqNullSafe(r["t"]), (r["y0"] - l["y1"] <= reach * (1 + 1e-9)) & (l["y0"] - r["y1"] <= reach * (1 + 1e-9))
        met = met.filter(same_slot | l["t"].isNull() | (r["t"] == l["t"] + 1)).filter(within)
        step = functools.reduce(lambda least, c: F.when(l[c] < r[c], 1).when(l[c] > r[c], -1).otherwise(least), ("part", "b", "a"), F.lit(0))
        step = F.when(same_slot, step).otherwise(1)
        met = met.filter(step >= 0).filter(box_bounds(l, r)[0] <= km * (1 + 1e-9))
        met = met.select((step == 0).alias("same"), F.explode("events").alias("l"), "right_events").select("same", "l", F.explode("right_events").alias("r"))
        l, r = F.col("l"), F.col("r")
        met = met.filter(F.coalesce(F.abs(l["at"] - r["at"]) <= hours * 3600, F.lit(True)) & (~F.col("same") | (l["id"] < r["id"])))
        distance = haversine_of(l["y"], l["x"], l["cos"], r["y"], r["x"], r["cos"], RADIUS)
        met = met.filter(distance <= km).select(F.least("l.id", "r.id").alias("id_a"), F.greatest("l.id", "r.id").alias("id_b"), distance.alias("km"))
        return met.filter("id_a < id_b")

    return functools.reduce(DataFrame.unionAll, map(opened, met))


def _touching(parts: DataFrame) -> DataFrame:
    """Pairs (l, r) of parts (class, k0, k1, k2, part) of different classes whose cells are the same or touch, each once."""
    near = (-1, 0, 1)
    steps = [(i, j, k) for i in near for j in near for k in near if (i, j, k) >= (0, 0, 0)]
    # Parts without a time are a layer of their own.
    layer = [F.col("k2").isNull().alias("untimed"), F.coalesce("k2", F.lit(0)).alias("k2")]
    left = parts.select("class", F.col("part").alias("l"), "k0", "k1", *layer)
    to = F.explode(F.array(*(F.struct(*((F.col(f"k{i}") + d).alias(f"k{i}") for i, d in enumerate(s))) for s in steps))).alias("to")
    sent = left.select("class", "l", "untimed", to).select("class", "l", "untimed", "to.*")
    right = parts.select(F.col("class").alias("other"), F.col("part").alias("r"), "k0", "k1", *layer)
    return sent.join(right.hint("merge"), ["k0", "k1", "k2", "untimed"]).filter("class <> other")


def _apart(open_: DataFrame, stars: DataFrame) -> DataFrame:
    """The pairs (u, v) of ``open_`` that ``stars`` (node, component) do not connect already."""
    for c in ("u", "v"):
        named = stars.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        open_ = open_.join(named.hint("merge"), c, "left")
    return open_.filter(F.coalesce("u_in", "u") != F.coalesce("v_in", "v")).select("u", "v")


def class_links(events: DataFrame, km: float = 25.0, hours: float = 168.0, cuts: tuple[int, ...] = (4, 16)) -> tuple[DataFrame, DataFrame]:
    """(classes (a, b, t, id), links (u, v) between ids of classes): what single linkage needs of the pairs of events.

    Events of a class are linked, so its smallest id stands for them.  Two classes are linked if any of
    their events are: mostly their bounds tell.  Next, parts half as wide that touch link their classes where
    their bounds tell so.  For the others, cells ``cuts`` times finer are compared in turn, and at last the
    places and times themselves.  Before each turn, links become stars from the smallest id of what they
    connect, and pairs of classes that are connected already, by whatever way, are not looked into
    further: where events are dense, hardly a pair is left.
    """
    rows = classes(events.select("id", "latitude", "longitude", "at"), km, hours)
    boxes = written(_boxes(rows, "a", "b", "t"), "classes")
    met = _neighbours(boxes, km).withColumn("near", _nearness(km, hours)).filter("near >= 0")
    met = written(met.select(F.col("l.id").alias("u"), F.col("r.id").alias("v"), F.col("near").alias("near")), "neighbours")
    found, open_ = [met.filter("near = 1").select("u", "v")], met.filter("near = 0").select("u", "v")
    named = of_class(rows, boxes.select("a", "b", "t", F.col("id").alias("class"))).select("id", "latitude", "longitude", "at", "class")
    size, _ = degrees_of(km / math.sqrt(2))

    def parts_of(cut: int | None) -> DataFrame:
        fine = [F.floor(F.col(c) * cut / w) for c, w in (("latitude", size), ("longitude", size), ("at", hours * 3600))] if cut else None
        keys = {f"k{i}": c for i, c in enumerate(fine or map(F.col, ("latitude", "longitude", "at")))}
        return written(_boxes(named.withColumns(keys), "class", *keys).select("class", *keys, F.struct(*_BOX).alias("part")), "parts")

    if open_.limit(1).count():
        found.append(_touching(parts_of(2)).filter(_nearness(km, hours) == 1).select(F.col("class").alias("u"), F.col("other").alias("v")))
    for cut in (*cuts, None):
        if not open_.limit(1).count():
            break
        stars = components(functools.reduce(DataFrame.unionAll, found))
        found = [stars.select(F.col("component").alias("u"), F.col("node").alias("v"))]
        open_ = written(_apart(open_, stars), "open")
        if not open_.limit(1).count():
            break
        parts = parts_of(cut)
        side = lambda c, name: parts.select(F.col("class").alias(c), F.col("part").alias(name)).hint("merge")
        pairs = open_.join(side("u", "l"), "u").join(side("v", "r"), "v")
        if cut:
            near = _nearness(km, hours)
        else:
            l, r = F.col("l"), F.col("r")
            distance = haversine(l["y0"], l["x0"], r["y0"], r["x0"], RADIUS)
            near = F.when((distance <= km) & F.coalesce(F.abs(l["s0"] - r["s0"]) <= hours * 3600, F.lit(True)), 1).otherwise(-1)
        state = written(pairs.groupBy("u", "v").agg(F.max(near).alias("near"), F.max((near == 0).cast("int")).alias("open")), "decided")
        found.append(state.filter("near = 1").select("u", "v"))
        open_ = state.filter("near < 1 and open = 1").select("u", "v")
    return boxes.select("a", "b", "t", "id"), functools.reduce(DataFrame.unionAll, found)


def of_class(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Rows with what ``named`` has for their class (a, b, t), t being null or not."""
    keys = ("a", "b", "t")
    right = named.select(*(F.col(c).alias(f"of_{c}" if c in keys else c) for c in named.columns)).hint("merge")
    return rows.join(right, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys])


def membership(events: DataFrame, km: float = 25.0, hours: float = 168.0) -> DataFrame:
    """Events with ``component``, the smallest id of their single-linkage cluster."""
    held, links = class_links(events, km, hours)
    stars = components(links).select(F.col("node").alias("id"), "component")
    named = held.join(stars.hint("merge"), "id", "left").select("a", "b", "t", F.coalesce("component", "id").alias("component"))
    return of_class(classes(events, km, hours), named).select(*events.columns, "component")


def event_clusters(events: DataFrame, km: float = 25.0, hours: float = 168.0) -> DataFrame:
    """The clusters of events, see ``described``."""
    return described(written(membership(usable(events), km, hours), "members"))


def described(member: DataFrame) -> DataFrame:
    """One row per cluster: members, centre, radius from the centre, time span; member has component, latitude, longitude, at."""
    centre = member.groupBy("component").agg(
        F.count("*").alias("members"), F.avg("latitude").alias("y"), F.avg("longitude").alias("x"),
        ((F.max("at") - F.min("at")) / 3600).alias("span"),
    )
    # Clusters may be as many as events, or one may hold most: merged, and a large one may be split.
    away = member.join(centre.hint("merge"), "component")
    distance = haversine(F.col("y"), F.col("x"), F.col("latitude"), F.col("longitude"), RADIUS)
    radius = away.groupBy("component").agg(F.max(distance).alias("radius"))
    return centre.join(radius.hint("merge"), "component").select(
        F.col("component").alias("cluster_id"), "members", F.round("y", 6).alias("latitude"), F.round("x", 6).alias("longitude"),
        F.round("radius", 4).alias("radius_km"), F.round(F.coalesce("span", F.lit(0.0)), 4).alias("time_span_hours"),
    )


def cluster_summary(member: DataFrame) -> DataFrame:
    """Class counts, mean confidence, bounds and span per cluster; member has component, classification, confidence."""
    return member.groupBy("component").agg(
        F.count("*").alias("members"), F.countDistinct("classification").alias("classes"), F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"),
    )


def nearest_events(events: DataFrame, selected: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` nearest other events of one selected event (a one-row table, broadcast)."""
    one = selected.select(F.col("id").alias("selected_id"), F.col("latitude").alias("y"), F.col("longitude").alias("x")).limit(1)
    met = events.select("id", "latitude", "longitude").crossJoin(F.broadcast(one)).filter("id <> selected_id")
    km = haversine(F.col("y"), F.col("x"), F.col("latitude"), F.col("longitude"), RADIUS)
    top = met.select("selected_id", "id", km.alias("km")).orderBy("km", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("selected_id").orderBy("km", "id")))
