"""General polygons beside boxes: areas, overlaps, containment and distance.

A shape is a set of columns with a prefix: its box (xmin, ymin, xmax, ymax), and, if it
is more than a box, ``rings`` and ``edges`` (see ``with_rings``). Functions that take a
frame look at its columns, so that frames of boxes keep the cheap expressions.

Rings are closed arrays of struct(x, y), outer ones and holes in any order and direction:
a point is inside if it is inside an odd number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.geometry import _crossed, _edges, box, box_distance, box_overlap, box_ring, in_box, in_polygon, polygon_distance, ring_area, ring_area_signed, ring_centroid

BOX = ("xmin", "ymin", "xmax", "ymax")
SHAPE = ("rings", "edges")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ring_signs(rings: Column) -> Column:
    """1 for rings inside an even number of others, -1 for holes."""
    start = lambda r: F.element_at(r, 1)

    def sign(ring: Column, i: Column) -> Column:
        around = F.filter(rings, lambda other, j: (j != i) & _crossed(start(ring)["x"], start(ring)["y"], other))
        return F.when(F.size(around) % 2 == 0, 1.0).otherwise(-1.0)

    return F.when(F.size(rings) == 1, F.array(F.lit(1.0))).otherwise(F.transform(rings, sign))


def rings_area(rings: Column) -> Column:
    return _total(F.zip_with(rings, ring_signs(rings), lambda r, s: s * ring_area(r)))


def rings_centroid(rings: Column) -> Column:
    """Centre of mass of a shape with holes and parts, as struct(x, y)."""
    weights = F.zip_with(rings, ring_signs(rings), lambda r, s: s * ring_area(r))
    part = lambda c: _total(F.zip_with(rings, weights, lambda r, w: w * ring_centroid(r)[c])) / _total(weights)
    return F.struct(part("x").alias("x"), part("y").alias("y"))


def shape_edges(rings: Column) -> Column:
    """The rings' edges from left to right (x0, y0, x1, y1), each with the sign by which the
    area below it counts; upright edges have no area below them and are left out."""

    def of(ring: Column, sign: Column) -> Column:
        turn = F.when(ring_area_signed(ring) < 0, -sign).otherwise(sign)

        def edge(e: Column) -> Column:
            a, b = e["a"], e["b"]
            left, right = F.when(a["x"] <= b["x"], a).otherwise(b), F.when(a["x"] <= b["x"], b).otherwise(a)
            down = F.when(a["x"] < b["x"], -turn).otherwise(turn)
            return F.struct(left["x"].alias("x0"), left["y"].alias("y0"), right["x"].alias("x1"), right["y"].alias("y1"), down.alias("s"))

        return F.filter(F.transform(_edges(ring), edge), lambda e: e["x0"] < e["x1"])

    return F.flatten(F.zip_with(rings, ring_signs(rings), of))


def edges_overlap(a: Column, b: Column, origin: tuple[Column, Column] | None = None) -> Column:
    """Area that two shapes share, from their edges; ``origin`` is a point near them, which
    is read for every pair of edges and so should be plain columns.

    A shape is the sum of the areas below its edges, with their signs. The area below
    both of two edges is the integral of the lower one over the part of the axis that they
    share, so the shared area is the signed sum of that over all pairs of edges.
    """
    ox, oy = origin or (a[0]["x0"], a[0]["y0"])  # near the shapes, so that no digits are lost

    def below(e: Column, f: Column) -> Column:
        p, q = F.greatest(e["x0"], f["x0"]), F.least(e["x1"], f["x1"])
        at = lambda g, x: g["y0"] + (g["y1"] - g["y0"]) * ((x - g["x0"]) / (g["x1"] - g["x0"])) - oy
        fp, fq = at(f, p), at(f, q)
        dp, dq = at(e, p) - fp, at(e, q) - fq
        # of the difference, the part where the first edge is the lower one
        lower = F.when((dp <= 0) & (dq <= 0), dp + dq).when((dp >= 0) & (dq >= 0), F.lit(0.0)).when(dp < 0, dp * (dp / (dp - dq))).otherwise(dq * (dq / (dq - dp)))
        return F.when(p < q, e["s"] * f["s"] * (fp + fq + lower) / 2 * (q - p)).otherwise(0.0)

    moved = lambda edges: F.transform(edges, lambda e: F.struct((e["x0"] - ox).alias("x0"), e["y0"].alias("y0"), (e["x1"] - ox).alias("x1"), e["y1"].alias("y1"), e["s"].alias("s")))
    return _total(F.transform(moved(a), lambda e: F.aggregate(moved(b), F.lit(0.0), lambda acc, f: acc + below(e, f))))


def with_rings(df: DataFrame, rings: Column, prefix: str) -> DataFrame:
    """The columns of a shape: its box, its rings and their edges."""
    df = df.withColumn(f"{prefix}rings", rings)
    corner = lambda c: F.transform(F.flatten(f"{prefix}rings"), lambda p: p[c])
    ends = {"xmin": F.array_min(corner("x")), "ymin": F.array_min(corner("y")), "xmax": F.array_max(corner("x")), "ymax": F.array_max(corner("y"))}
    return df.withColumns({prefix + k: v for k, v in ends.items()} | {f"{prefix}edges": shape_edges(F.col(f"{prefix}rings"))})


def shape_columns(df: DataFrame, prefix: str) -> list[str]:
    return [prefix + c for c in BOX + SHAPE if prefix + c in df.columns]


def _general(df: DataFrame, prefix: str) -> bool:
    return f"{prefix}rings" in df.columns


def shape_area(df: DataFrame, prefix: str) -> Column:
    x0, y0, x1, y1 = box(prefix)
    return F.round(rings_area(F.col(f"{prefix}rings")), 6) if _general(df, prefix) else (x1 - x0) * (y1 - y0)


def shape_overlap(df: DataFrame, a: str, b: str) -> Column:
    """Area shared by two shapes of a row, rounded to a square millimetre unless both are boxes."""
    if not _general(df, a) and not _general(df, b):
        return box_overlap(a, b)
    edges = [F.col(f"{p}edges") if _general(df, p) else shape_edges(F.array(box_ring(p))) for p in (a, b)]
    return F.round(edges_overlap(*edges, origin=box(a)[:2]), 6)


def in_shape(df: DataFrame, prefix: str, x: Column, y: Column, strict: bool = False) -> Column:
    near = in_box(x, y, prefix, strict)
    return near & in_polygon(x, y, F.col(f"{prefix}rings"), strict) if _general(df, prefix) else near


def shape_distance(df: DataFrame, prefix: str, x: Column, y: Column) -> Column:
    """Distance of a point from a shape, 0 inside; rounded to a nanometre unless it is a box."""
    return F.round(polygon_distance(x, y, F.col(f"{prefix}rings")), 9) if _general(df, prefix) else box_distance(x, y, prefix)


def with_interior_point(df: DataFrame, rings: str, out: str) -> DataFrame:
    """``out``: a point inside, the middle of the widest stretch of a level line that lies
    inside. The line is half way between the middle height and the next corner above it.
    Each step is a column of its own, so that it is computed once."""
    heights = F.array_sort(F.array_distinct(F.transform(F.flatten(rings), lambda p: p["y"])))
    df = df.withColumn("_ys", heights).withColumn("_middle", (F.array_min("_ys") + F.array_max("_ys")) / 2)
    below, above = F.array_max(F.filter("_ys", lambda y: y <= F.col("_middle"))), F.array_min(F.filter("_ys", lambda y: y > F.col("_middle")))
    df = df.withColumn("_level", (below + above) / 2)
    level = F.col("_level")
    met = F.filter("_es", lambda e: (e["a"]["y"] > level) != (e["b"]["y"] > level))
    df = df.withColumn("_es", F.flatten(F.transform(rings, _edges))).withColumn("_es", met)
    df = df.withColumn("_xs", F.array_sort(F.transform("_es", lambda e: e["a"]["x"] + (level - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"]))))
    # every second stretch between crossings lies inside; the widest, the left one of equals
    gaps = F.transform("_xs", lambda x, i: F.when(i % 2 == 0, F.struct((F.try_element_at("_xs", i + 2) - x).alias("w"), (-x).alias("l"))))
    widest = F.array_max(F.filter(gaps, lambda g: g.isNotNull()))
    df = df.withColumn("_gap", widest).withColumn(out, F.struct((F.col("_gap.w") / 2 - F.col("_gap.l")).alias("x"), level.alias("y")))
    return df.drop("_ys", "_middle", "_level", "_es", "_xs", "_gap")


def touches_box(rings: Column, prefix: str) -> Column:
    """Whether rings share a point with a box: a corner of one is in the other, or an edge
    of the rings crosses the box."""
    x0, y0, x1, y1 = box(prefix)
    inside = F.exists(F.flatten(rings), lambda p: (p["x"] >= x0) & (p["x"] <= x1) & (p["y"] >= y0) & (p["y"] <= y1))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        side = lambda x, y: F.signum((b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]))
        sides = F.array(side(x0, y0), side(x1, y0), side(x1, y1), side(x0, y1))
        meets = (F.least(a["x"], b["x"]) <= x1) & (F.greatest(a["x"], b["x"]) >= x0) & (F.least(a["y"], b["y"]) <= y1) & (F.greatest(a["y"], b["y"]) >= y0)
        return meets & (F.array_min(sides) <= 0) & (F.array_max(sides) >= 0)

    return inside | F.exists(F.flatten(F.transform(rings, _edges)), crosses) | in_polygon(x0, y0, rings)
