"""Plane and tile geometry as Column expressions.

Coordinates are metres in a local projection unless a name says lon or lat. Boxes are
the columns xmin, ymin, xmax, ymax with a prefix; rings are arrays of struct(x, y), the
first point repeated at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_LON = 111320.0
METRES_LAT = 110540.0
EARTH = 6378137.0
POINT = "struct<x:double,y:double>"


def project(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin."""
    return (lon - lon0) * METRES_LON * F.cos(F.radians(lat0)), (lat - lat0) * METRES_LAT


def unproject(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return lon0 + x / (METRES_LON * F.cos(F.radians(lat0))), lat0 + y / METRES_LAT


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in ("xmin", "ymin", "xmax", "ymax"))


def in_box(x: Column, y: Column, prefix: str, strict: bool = False) -> Column:
    """Whether a point lies in a box; on its edge only if not ``strict``."""
    x0, y0, x1, y1 = box(prefix)
    return (x > x0) & (x < x1) & (y > y0) & (y < y1) if strict else (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)


def box_distance(x: Column, y: Column, prefix: str) -> Column:
    """Distance of a point from a box, 0 inside."""
    x0, y0, x1, y1 = box(prefix)
    dx, dy = F.greatest(x0 - x, F.lit(0.0), x - x1), F.greatest(y0 - y, F.lit(0.0), y - y1)
    return F.sqrt(dx * dx + dy * dy)


def box_overlap(a: str, b: str) -> Column:
    """Area that two boxes share."""
    ax0, ay0, ax1, ay1 = box(a)
    bx0, by0, bx1, by1 = box(b)
    return F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))


def box_ring(prefix: str = "") -> Column:
    x0, y0, x1, y1 = box(prefix)
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))


def circle_ring(x: Column, y: Column, radius: Column | float, corners: int = 32) -> Column:
    """A regular polygon on a circle round a point."""
    r = F.lit(radius) if isinstance(radius, (int, float)) else radius
    turn = F.sequence(F.lit(0), F.lit(corners))
    return F.transform(turn, lambda i: F.struct((x + r * F.cos(i % corners * (2 * math.pi / corners))).alias("x"), (y + r * F.sin(i % corners * (2 * math.pi / corners))).alias("y")))


def _edges(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ring_area_signed(ring: Column) -> Column:
    return _sum(F.transform(_edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(ring_area_signed(ring))


def polygon_area(rings: Column) -> Column:
    """Area of a polygon with holes: the first ring less the others."""
    areas = F.transform(rings, ring_area)
    return F.aggregate(areas, F.lit(0.0), lambda acc, a: acc - a, lambda acc: acc + 2 * F.element_at(areas, 1))


def ring_centroid(ring: Column) -> Column:
    """Centre of mass, as struct(x, y); the mean of the corners for a ring without area."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    area = ring_area_signed(ring)
    part = lambda c: _sum(F.transform(_edges(ring), lambda e: (e["a"][c] + e["b"][c]) * cross(e))) / (6 * area)
    mean = lambda c: _sum(F.transform(F.slice(ring, 1, F.size(ring) - 1), lambda p: p[c])) / (F.size(ring) - 1)
    return F.when(area != 0, F.struct(part("x").alias("x"), part("y").alias("y"))).otherwise(F.struct(mean("x").alias("x"), mean("y").alias("y")))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / length2))).otherwise(0.0)
    ex, ey = x - (ax + t * dx), y - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point from a ring's line."""
    return F.array_min(F.transform(_edges(ring), lambda e: segment_distance(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies exactly on a ring's line."""

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straight = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return straight & (x >= F.least(a["x"], b["x"])) & (x <= F.greatest(a["x"], b["x"])) & (y >= F.least(a["y"], b["y"])) & (y <= F.greatest(a["y"], b["y"]))

    return F.exists(_edges(ring), on)


def _crossed(x: Column, y: Column, ring: Column) -> Column:
    def crossing(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.aggregate(F.transform(_edges(ring), crossing), F.lit(0), lambda acc, v: acc + v) % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column, strict: bool = False) -> Column:
    """Whether a point lies in a polygon with holes; on an edge only if not ``strict``."""
    edge = F.exists(rings, lambda r: on_ring(x, y, r))
    inside = F.aggregate(F.transform(rings, lambda r: _crossed(x, y, r).cast("int")), F.lit(0), lambda acc, v: acc + v) % 2 == 1
    return inside & ~edge if strict else inside | edge


def polygon_distance(x: Column, y: Column, rings: Column) -> Column:
    return F.when(in_polygon(x, y, rings), 0.0).otherwise(F.array_min(F.transform(rings, lambda r: ring_distance(x, y, r))))


def turn_degrees(a: tuple, b: tuple, c: tuple, lat: Column) -> Column:
    """Change of direction at b on the way a, b, c of (lon, lat) columns; 0 for equal points."""
    k = F.cos(F.radians(lat))
    ux, uy, vx, vy = (b[0] - a[0]) * k, b[1] - a[1], (c[0] - b[0]) * k, c[1] - b[1]
    norm = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    return F.when(norm > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / norm))))).otherwise(0.0)


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the sphere between two points, by the haversine formula."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(h))


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lon + 180) / 360 * n))).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    r = F.radians(lat)
    y = (1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(y))).cast("long")


def mercator_to_lon(x: Column) -> Column:
    return F.degrees(x / EARTH)


def mercator_to_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


def hilbert_tile(zoom: int, x: Column, y: Column) -> Column:
    """Number of a tile in the order of zooms, and of the Hilbert curve within a zoom."""
    base = ((1 << (2 * zoom)) - 1) // 3
    d, px, py = F.lit(base).cast("long"), x.cast("long"), y.cast("long")
    state = F.struct(d.alias("d"), px.alias("x"), py.alias("y"))

    def step(acc: Column, s: Column) -> Column:
        rx = F.when(acc["x"].bitwiseAND(s) > 0, 1).otherwise(0)
        ry = F.when(acc["y"].bitwiseAND(s) > 0, 1).otherwise(0)
        more = s * s * (3 * rx).bitwiseXOR(ry)
        fx = F.when((ry == 0) & (rx == 1), s - 1 - acc["x"].bitwiseAND(s - 1)).otherwise(acc["x"].bitwiseAND(s - 1))
        fy = F.when((ry == 0) & (rx == 1), s - 1 - acc["y"].bitwiseAND(s - 1)).otherwise(acc["y"].bitwiseAND(s - 1))
        return F.struct((acc["d"] + more).alias("d"), F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"))

    if zoom == 0:
        return d
    halves = F.array(*[F.lit(1 << level).cast("long") for level in range(zoom - 1, -1, -1)])
    return F.aggregate(halves, state, step, lambda acc: acc["d"])
