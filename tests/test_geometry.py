import math
import random

import pytest
from pyspark.sql import functions as F

from plotline.functions import geometry as G
from plotline.operators import chains, placing, spacing
from plotline.operators.grid import grid_join
from plotline.sources import tiles


def rings(points):
    return F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring]) for ring in points])


COURT = [[(0, 0), (40, 0), (40, 40), (0, 40), (0, 0)], [(12, 12), (28, 12), (28, 28), (12, 28), (12, 12)]]


def wkt(points):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in points) + ")"


def test_polygons_against_an_independent_library(spark):
    jvm = spark._jvm.org.locationtech.jts
    reader = jvm.io.WKTReader()
    rng = random.Random(4)
    star = [[(20 + r * math.cos(i / 9 * 2 * math.pi), 20 + r * math.sin(i / 9 * 2 * math.pi)) for i, r in enumerate(rng.uniform(5, 20) for _ in range(9))]]
    star[0].append(star[0][0])
    for shape in (COURT, star):
        jts = reader.read(wkt(shape))
        row = spark.range(1).select(G.polygon_area(rings(shape)).alias("a"), G.ring_centroid(rings(shape)[0]).alias("c")).first()
        assert row["a"] == pytest.approx(jts.getArea())
        points = [(rng.uniform(-10, 50), rng.uniform(-10, 50)) for _ in range(60)] + [(0.0, 5.0), (12.0, 20.0), (40.0, 40.0)]
        df = spark.createDataFrame(points, "x double, y double")
        p = rings(shape)
        got = df.select("x", "y", G.in_polygon(F.col("x"), F.col("y"), p).alias("closed"), G.in_polygon(F.col("x"), F.col("y"), p, strict=True).alias("strict"), G.polygon_distance(F.col("x"), F.col("y"), p).alias("d")).collect()
        for r in got:
            q = reader.read(f"POINT ({r['x']} {r['y']})")
            assert r["closed"] == jts.intersects(q) and r["strict"] == jts.contains(q) and r["d"] == pytest.approx(jts.distance(q), abs=1e-9)


def test_grid_join_finds_each_pair_once(spark):
    rng = random.Random(1)
    def boxes(n, p):
        out = []
        for i in range(n):
            x, y = rng.uniform(-200, 200), rng.uniform(-200, 200)
            out.append((i, x, y, x + rng.uniform(0, 90), y + rng.uniform(0, 90)))
        return out, spark.createDataFrame(out, f"{p}id long, {p}xmin double, {p}ymin double, {p}xmax double, {p}ymax double")
    a, da = boxes(60, "a")
    b, db = boxes(60, "b")
    want = sorted((i[0], j[0]) for i in a for j in b if i[1] <= j[3] and j[1] <= i[3] and i[2] <= j[4] and j[2] <= i[4])
    assert sorted((r["aid"], r["bid"]) for r in grid_join(da, db, "a", "b", 25.0).collect()) == want


def test_nearest_site_cells(spark):
    grid = [(i, float(i % 5 * 20), float(i // 5 * 20)) for i in range(25)]
    sites = spark.createDataFrame(grid, "sid long, sx double, sy double")
    wide = spark.createDataFrame([(i, 1000.0) for i in range(25)], "sid long, reach double")
    near = {r["sid"]: r["area"] for r in spacing.site_cells(sites, wide).collect()}
    assert near[12] == pytest.approx(400)
    trimmed = {r["sid"]: r["area"] for r in spacing.site_cells(sites, wide.withColumn("reach", F.lit(9.0))).collect()}
    assert all(a == pytest.approx(16 * 81 * math.sin(2 * math.pi / 32), rel=1e-9) for a in trimmed.values())
    assert {r["spacing"] for r in spacing.local_spacing(sites, 5.0).collect()} == {20.0}


def test_parcel_shift_is_found(spark):
    lots = [(f"P{i}", i % 10 * 20.0 - 10 + 4, i // 10 * 30.0 - 15 - 3, i % 10 * 20.0 + 10 + 4, i // 10 * 30.0 + 15 - 3) for i in range(40)]
    parcels = spark.createDataFrame(lots, "cell_id string, cxmin double, cymin double, cxmax double, cymax double")
    points = [(i, i % 10 * 20.0 + dx, i // 10 * 30.0 + dy) for i in range(40) for dx in range(-9, 10, 3) for dy in (-14, 14)]
    points += [(i, i % 10 * 20.0 + dx, i // 10 * 30.0 + dy) for i in range(40) for dy in range(-12, 13, 4) for dx in (-9, 9)]
    dx, dy = spacing.best_shift(spark.createDataFrame(points, "bid long, x double, y double"), parcels)
    assert abs(dx + 4) <= 1 and abs(dy - 3) <= 1


def test_chains(spark):
    rows = [("a", 1, [1, 2], [0.0, 10.0], [0.0, 0.0]), ("a", 2, [3, 2], [20.0, 10.0], [1.0, 0.0]), ("a", 3, [2, 4], [10.0, 10.0], [0.0, 9.0]), ("b", 4, [7, 8], [0.0, 1.0], [5.0, 5.0])]
    got = chains.road_chains(spark.createDataFrame(rows, "key string, way long, nodes array<long>, xs array<double>, ys array<double>")).collect()
    assert sorted((r["key"], sorted(r["ways"])) for r in got) == [("a", [1, 2]), ("a", [3]), ("b", [4])]
    assert next(r for r in got if 1 in r["ways"])["nodes"] in ([1, 2, 3], [3, 2, 1])


def test_places_in_a_footprint(spark):
    rows = [(i, 1, 0.0, 0.0, -10.0, -8.0, 10.0, 8.0) for i in range(6)]
    got = placing.placed(spark.createDataFrame(rows, "id long, bid long, x double, y double, bxmin double, bymin double, bxmax double, bymax double")).collect()
    spots = [(r["px"], r["py"]) for r in got]
    assert len(set(spots)) == 6 and all(-10 < x < 10 and -8 < y < 8 for x, y in spots)
    assert min(math.dist(a, b) for i, a in enumerate(spots) for b in spots[:i]) >= 2


def test_tile_numbers_go_both_ways(spark):
    df = spark.createDataFrame([(x, y) for x in range(8) for y in range(8)], "x long, y long").withColumn("t", G.hilbert_tile(3, F.col("x"), F.col("y")))
    rows = df.collect()
    assert sorted(r["t"] for r in rows) == list(range(21, 85))
    assert all(tiles.tile_of(r["t"]) == (3, r["x"], r["y"]) for r in rows)
