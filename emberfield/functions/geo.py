"""Distances and bearings as column expressions, and the cells that bound a search."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii in km, of the history functions and of all others.
HISTORY_RADIUS = 6371.0088
RADIUS = 6371.0

#: The sixteen directions.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    return haversine_of(a, F.radians(lon1), F.cos(a), b, F.radians(lon2), F.cos(b), radius)


def haversine_of(y1: Column, x1: Column, cos1: Column, y2: Column, x2: Column, cos2: Column, radius: float = RADIUS) -> Column:
    """The same of places in radians, with the cosines of their latitudes ready made."""
    h = F.pow(F.sin((y2 - y1) / 2), F.lit(2.0)) + cos1 * cos2 * F.pow(F.sin((x2 - x1) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def box_bounds(left: dict[str, Column], right: dict[str, Column], radius: float = RADIUS) -> tuple[Column, Column]:
    """(least, most) distance between any points of two boxes y0..y1, x0..x1 in degrees: no tighter than true, and exact for points.

    By the haversine formula, a distance is no less than that of the gaps between the boxes at the
    smallest cosines, and no more than that of their spans at the largest.
    """
    # The right box on the same side of the 180th meridian.
    turn = 360 * F.round((left["x0"] + left["x1"] - right["x0"] - right["x1"]) / 720)
    x0, x1 = right["x0"] + turn, right["x1"] + turn
    gap_y = F.greatest(F.lit(0.0), right["y0"] - left["y1"], left["y0"] - right["y1"])
    gap_x = F.greatest(F.lit(0.0), x0 - left["x1"], left["x0"] - x1)
    span_y = F.greatest(right["y1"] - left["y0"], left["y1"] - right["y0"])
    span_x = F.greatest(x1 - left["x0"], left["x1"] - x0)

    def cosines(box: dict[str, Column]) -> tuple[Column, Column]:
        ends = [F.cos(F.radians(box[c])) for c in ("y0", "y1")]
        # A box across the equator has its largest cosine there.
        across = F.when((box["y0"] <= 0) & (box["y1"] >= 0), F.lit(1.0)).otherwise(F.lit(0.0))
        return F.least(*ends), F.greatest(*ends, across)

    def km(y: Column, x: Column, cos: Column) -> Column:
        half = lambda a: F.pow(F.sin(F.radians(F.least(a, F.lit(180.0))) / 2), F.lit(2.0))
        return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(half(y) + cos * half(x))))

    (low_l, high_l), (low_r, high_r) = cosines(left), cosines(right)
    return km(gap_y, gap_x, low_l * low_r), km(span_y, span_x, high_l * high_r)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(deg + 360, F.lit(360.0))


def compass(degrees: Column) -> Column:
    return F.get(F.array(*map(F.lit, COMPASS)), F.pmod(F.floor(degrees / 22.5 + 0.5), F.lit(16)).cast("int"))


def ring(km: Column) -> Column:
    return F.when(km <= 1, "near").when(km <= 5, "mid").otherwise("far")


def degrees_of(km: float, lat: float = 0.0, radius: float = RADIUS) -> tuple[float, float]:
    """Degrees of latitude and, at most at this latitude, of longitude that a distance spans."""
    dlat = math.degrees(km / radius)
    s = math.sin(km / radius / 2) / max(math.cos(math.radians(min(89.0, abs(lat) + dlat))), 1e-3)
    return dlat, math.degrees(2 * math.asin(min(1.0, s)))
