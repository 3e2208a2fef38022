"""Geometry: great-circle distance, boxes and polygons as columns; shapes, geohashes and points by plain functions."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
UNITS = {"mm": 1e-6, "cm": 1e-5, "m": 1e-3, "km": 1.0, "in": 2.54e-5, "ft": 3.048e-4, "yd": 9.144e-4, "mi": 1.609344, "nmi": 1.852, "nm": 1.852}
UNITS |= {"millimeters": 1e-6, "centimeters": 1e-5, "meters": 1e-3, "kilometers": 1.0, "inch": 2.54e-5, "feet": 3.048e-4, "yards": 9.144e-4, "miles": 1.609344, "nauticalmiles": 1.852}
_B32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def km(distance: str | float) -> float:
    """A distance with its unit (metres without one) in kilometres."""
    m = re.fullmatch(r"\s*([0-9.]+)\s*([A-Za-z]*)\s*", str(distance))
    if not m or (m[2] and m[2].lower() not in UNITS):
        raise ValueError(f"bad distance {distance!r}")
    return float(m[1]) * UNITS[m[2].lower() or "m"]


def point(value) -> tuple[float, float]:
    """(lon, lat) of [lon, lat], "lat,lon", a geohash, {lat, lon} or a GeoJSON point."""
    if isinstance(value, str):
        if "," in value:
            lat, lon = map(float, value.split(","))
            return lon, lat
        return geohash_decode(value)
    if isinstance(value, dict):
        if "coordinates" in value:
            return tuple(map(float, value["coordinates"][:2]))
        return float(value.get("lon", value.get("lng"))), float(value["lat"])
    return float(value[0]), float(value[1])


def geohash_encode(lon: float, lat: float, size: int = 12) -> str:
    box, out, bits, n, even = [[-180.0, 180.0], [-90.0, 90.0]], "", 0, 0, True
    while len(out) < size:
        b, v = (box[0], lon) if even else (box[1], lat)
        mid = (b[0] + b[1]) / 2
        bits = bits * 2 + (v >= mid)
        b[v < mid] = mid
        even, n = not even, n + 1
        if n == 5:
            out, bits, n = out + _B32[bits], 0, 0
    return out


def geohash_decode(h: str) -> tuple[float, float]:
    box, even = [[-180.0, 180.0], [-90.0, 90.0]], True
    for c in h.lower():
        for k in range(4, -1, -1):
            b = box[0] if even else box[1]
            b[not (_B32.index(c) >> k & 1)] = (b[0] + b[1]) / 2
            even = not even
    return sum(box[0]) / 2, sum(box[1]) / 2


def haversine(lon1: Column, lat1: Column, lon2: float, lat2: float) -> Column:
    """Kilometres between points."""
    p1, p2 = F.radians(lat1), F.lit(math.radians(lat2))
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(F.lit(float(lon2)) - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def in_box(lon: Column, lat: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """Inclusive; a box whose left is east of its right crosses the date line."""
    across = lon.between(left, right) if left <= right else (lon >= left) | (lon <= right)
    return across & lat.between(bottom, top)


def within_distance(lon: Column, lat: Column, lon0: float, lat0: float, distance_km: float) -> Column:
    """A latitude band first, which a scan can push down, then the exact distance."""
    d = math.degrees(distance_km / EARTH_KM)
    return lat.between(lat0 - d, lat0 + d) & (haversine(lon, lat, lon0, lat0) <= distance_km)


def in_polygon(lon: Column, lat: Column, points: list[tuple[float, float]]) -> Column:
    """Ray casting over the polygon's edges."""
    inside = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if y1 != y2:
            cross = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < F.lit(x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            inside = inside + cross.cast("int")
    return inside % 2 == 1


# shapes


def _rings(g: dict) -> list[list[tuple[float, float]]]:
    t, c = g["type"].lower(), g.get("coordinates")
    if t == "point":
        return [[tuple(c)]]
    if t in ("multipoint", "linestring"):
        return [[tuple(p)] for p in c] if t == "multipoint" else [[tuple(p) for p in c]]
    if t in ("multilinestring", "polygon"):
        return [[tuple(p) for p in r] for r in c]
    if t == "multipolygon":
        return [[tuple(p) for p in r] for poly in c for r in poly]
    if t == "envelope":
        (l, top), (r, b) = c
        return [[(l, top), (r, top), (r, b), (l, b), (l, top)]]
    if t == "circle":
        lon, lat = c
        d = km(g["radius"]) / EARTH_KM
        return [[(lon + math.degrees(d) * math.cos(a) / max(1e-9, math.cos(math.radians(lat))), lat + math.degrees(d) * math.sin(a)) for a in (2 * math.pi * k / 64 for k in range(65))]]
    return [r for x in g.get("geometries", []) for r in _rings(x)]


def _area(g: dict) -> bool:
    return g["type"].lower() in ("polygon", "multipolygon", "envelope", "circle") or any(_area(x) for x in g.get("geometries", []))


def _inside(p: tuple[float, float], rings: list) -> bool:
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:]):
            if min(x1, x2) - 1e-12 <= p[0] <= max(x1, x2) + 1e-12 and min(y1, y2) - 1e-12 <= p[1] <= max(y1, y2) + 1e-12 and abs((x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)) < 1e-12:
                return True
            if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def _cross(a, b, c, d) -> bool:
    o = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return o(a, b, c) * o(a, b, d) < 0 and o(c, d, a) * o(c, d, b) < 0


def relate(a: dict, b: dict, relation: str) -> bool:
    """Whether shape a intersects, contains or is within shape b; circles and geometries are planar."""
    ra, rb = _rings(a), _rings(b)
    edges = lambda rs: [(p, q) for r in rs for p, q in zip(r, r[1:])]
    crossing = any(_cross(p, q, r, s) for p, q in edges(ra) for r, s in edges(rb))
    pa, pb = [p for r in ra for p in r], [p for r in rb for p in r]
    a_in_b = _area(b) and all(_inside(p, rb) for p in pa)
    b_in_a = _area(a) and all(_inside(p, ra) for p in pb)
    if relation == "within":
        return a_in_b and not crossing
    if relation == "contains":
        return b_in_a and not crossing
    return crossing or (_area(b) and any(_inside(p, rb) for p in pa)) or (_area(a) and any(_inside(p, ra) for p in pb)) or bool(set(pa) & set(pb))


def shape_predicate(column: Column, shape: dict, relation: str) -> Column:
    """Over a GeoJSON string column, by an Arrow-batched UDF."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda g: g is not None and relate(json.loads(g), shape, relation)).astype(bool)

    return run(column)


def ip_number(c: Column) -> Column:
    """A dotted IPv4 address as a number; null otherwise."""
    ok = c.rlike(r"^(25[0-5]|2[0-4]\d|[01]?\d?\d)(\.(25[0-5]|2[0-4]\d|[01]?\d?\d)){3}$")
    parts = F.split(c, r"\.")
    return F.when(ok, sum((parts[k].cast("long") * (1 << (24 - 8 * k)) for k in range(1, 4)), parts[0].cast("long") * (1 << 24)))
