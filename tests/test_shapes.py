import math
import random

import pytest
from pyspark.sql import functions as F

from plotline.functions import shapes as S
from plotline.functions.geometry import in_polygon
from plotline.operators import rings as R
from plotline.operators import spacing

SHAPE = "array<array<struct<x:double,y:double>>>"


def star(rng, x, y, most, corners=9):
    ring = [(x + r * math.cos(i / corners * 2 * math.pi), y + r * math.sin(i / corners * 2 * math.pi)) for i, r in enumerate(rng.uniform(most / 4, most) for _ in range(corners))]
    ring.append(ring[0])
    return ring if rng.random() < 0.5 else ring[::-1]


def square(x, y, side):
    return [(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)]


def test_overlaps_against_an_independent_library(spark):
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    rng = random.Random(6)
    text = lambda rings: "(" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings) + ")"

    def shape():
        x, y = rng.uniform(1000, 1030), rng.uniform(5000, 5030)
        polygons = [[star(rng, x, y, 15)]]
        if rng.random() < 0.5:
            polygons = [[square(x, y, 20), square(x + 4, y + 4, 5)[::-1]]]
        if rng.random() < 0.3:
            polygons.append([star(rng, x + 60, y, 12)])
        return polygons

    pairs = [(i, shape(), shape()) for i in range(120)]
    flat = lambda polygons: [[{"x": x, "y": y} for x, y in r] for p in polygons for r in p]
    df = spark.createDataFrame([(i, flat(a), flat(b)) for i, a, b in pairs], f"i long, a {SHAPE}, b {SHAPE}")
    df = S.with_rings(S.with_rings(df, F.col("a"), "a"), F.col("b"), "b")
    got = {r["i"]: r for r in df.select("i", S.shape_overlap(df, "a", "b").alias("o"), S.shape_area(df, "a").alias("area")).collect()}
    some = 0
    for i, a, b in pairs:
        ja, jb = (reader.read("MULTIPOLYGON (" + ", ".join(text(p) for p in x) + ")") for x in (a, b))
        want = ja.intersection(jb).getArea()
        some += want > 0
        assert got[i]["o"] == pytest.approx(want, abs=1e-5) and got[i]["area"] == pytest.approx(ja.getArea(), abs=1e-5)
    assert some > 30


def test_interior_points_and_boxes(spark):
    rng = random.Random(7)
    shapes = [(i, [[{"x": x, "y": y} for x, y in star(rng, 0, 0, 20)]]) for i in range(60)]
    df = S.with_rings(spark.createDataFrame(shapes, f"i long, r {SHAPE}"), F.col("r"), "s")
    inner = S.with_interior_point(df, "srings", "p")
    assert inner.where(~in_polygon(F.col("p.x"), F.col("p.y"), F.col("srings"), strict=True)).count() == 0
    boxes = df.withColumns({"vxmin": F.lit(-3.0), "vymin": F.lit(-3.0), "vxmax": F.lit(-2.0), "vymax": F.lit(-2.0)})
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    view = reader.read("POLYGON ((-3 -3, -2 -3, -2 -2, -3 -2, -3 -3))")
    for r in boxes.select("r", S.touches_box(F.col("srings"), "v").alias("t")).collect():
        ring = ", ".join(f"{p['x']} {p['y']}" for p in r["r"][0])
        assert r["t"] == reader.read(f"POLYGON (({ring}))").intersects(view)


def test_rings_are_stitched(spark):
    assert R.stitched([[1, 2], [3, 2], [3, 1], [7, 8], [9, 9]]) == [[1, 2, 3, 1]]
    assert R.stitched([[1, 2, 3, 1], [4, 5], [5, 6, 4]]) == [[1, 2, 3, 1], [4, 5, 6, 4]]
    assert R.stitched([]) == []


def test_nearest_sites_of_lost_and_far_points(spark):
    nan = float("nan")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, nan, 1.0), (4, 1e9, 1e9), (5, float("inf"), 0.0)], "pid long, px double, py double")
    sites = spark.createDataFrame([(i, float(i), 0.0) for i in range(30)] + [(98, None, 0.0), (99, nan, nan)], "sid long, sx double, sy double")
    got = [(r["pid"], r["rank"], r["sid"]) for r in spacing.nearest_sites(points, sites, 2, 1.0).orderBy("pid", "rank").collect()]
    assert got == [(1, 1, 0), (1, 2, 1), (4, 1, 29), (4, 2, 28)]
    assert spacing.nearest_sites(points, sites.limit(0), 2, 1.0).count() == 0
    assert spacing.nearest_sites(points, sites, 50, 1.0).count() == 60


def test_shift_estimate_needs_samples(spark):
    lots = [(f"P{i}", i * 20.0 - 10 + 4, -15.0, i * 20.0 + 10 + 4, 15.0) for i in range(40)]
    parcels = spark.createDataFrame(lots, "cell_id string, cxmin double, cymin double, cxmax double, cymax double")
    points = [(i, i * 20.0 + dx, float(dy)) for i in range(40) for dx in (-9, -3, 3, 9) for dy in (-9, 9)] + [(99, 5000.0, 5000.0)]
    samples = spark.createDataFrame(points, "bid long, x double, y double")
    r = spacing.shift_estimate(samples, parcels).first()
    assert r["samples"] == 40 and r["after"] == 1.0 and r["improved"] >= 38 and r["worsened"] == 0 and r["significant"] and abs(r["dx"] + 4) <= 1.5
    assert spacing.shift_estimate(samples.where("bid < 4"), parcels).count() == 0
