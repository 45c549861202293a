import random

import numpy as np
import pytest

from plotline.operators import arrangement as R
from plotline.operators import spacing as P

SQUARE = np.array([(0, 0), (20, 0), (20, 20), (0, 20)], float)


def lines(*ways):
    return np.array([(*a, *b) for way in ways for a, b in zip(way, way[1:])], float).reshape(-1, 4)


def sizes(*ways):
    return sorted(round(R.piece_area(p), 6) for p in R.pieces(SQUARE, lines(*ways)))


def test_pieces():
    assert sizes() == [400]
    assert sizes([(-5, 10), (25, 10)]) == [200, 200]
    assert sizes([(-5, 10), (10, 10)]) == [400]  # a road that ends in the cell
    assert sizes([(-5, 5), (10, 5), (10, -5)]) == [50, 350]  # one that bends in it
    assert sizes([(-5, 10), (10, 10), (30, 0)], [(10, 10), (10, 30)]) == [100, 125, 175]  # a junction
    assert sizes([(5, 5), (15, 5), (15, 15), (5, 15), (5, 5)]) == [100, 300]  # a loop within
    assert sizes([(5, 5), (15, 5), (15, 15), (5, 15), (5, 5)], [(10, 10), (12, 12)], [(2, 2), (5, 5)]) == [100, 300]
    assert sizes([(0, 0), (20, 0)]) == [400] and sizes([(0, 0), (20, 20)]) == [200, 200]  # along the border, corner to corner
    assert sizes([(30, 30), (40, 30), (40, 40), (30, 30)]) == [400]  # a loop outside
    assert sizes([(-5, 5), (25, 5)], [(-5, 5), (25, 5)], [(10, 5), (30, 5)]) == [100, 300]  # the same road again


def test_the_part_with_the_site():
    area = lambda site, *ways: round(R.piece_area(R.piece_of_site(SQUARE, lines(*ways), site)), 6)
    bend = [(-5, 5), (10, 5), (10, -5)]
    assert area((2, 2), bend) == 50 and area((2, 9), bend) == 350
    assert area((5, 5), bend) == 350  # on the road: the largest
    assert area((2, 25), [(-5, 10), (25, 10)]) == 200
    loop = [(5, 5), (15, 5), (15, 15), (5, 15), (5, 5)]
    assert area((10, 10), loop) == 100 and area((1, 1), loop) == 300


def test_cells_that_lines_lead_through_are_cut_alike():
    rng, cut = random.Random(5), 0
    for _ in range(300):
        turns = np.sort([rng.uniform(0, 2 * np.pi) for _ in range(rng.randrange(4, 9))])
        ring = np.column_stack([100 + 15 * np.cos(turns), 50 + 15 * np.sin(turns)])
        ways = lines(*[[(rng.uniform(60, 140), rng.uniform(20, 80)) for _ in range(2)] for _ in range(rng.randrange(1, 4))])
        site = (100 + rng.uniform(-8, 8), 50 + rng.uniform(-8, 8))
        through = R.cut_through(ring, ways, site)
        if through is not None:
            (held,) = [p for p in R.pieces(ring, ways) if R.covers(p, site)]
            assert R.piece_area([through]) == pytest.approx(R.piece_area(held), abs=1e-5) and R.covers([through], site)
            cut += len(R.pieces(ring, ways)) > 1
    assert cut > 50
    assert R.cut_through(SQUARE, lines([(-5, 10), (10, 10)]), (2.0, 2.0)) is None and R.cut_through(SQUARE, lines([(-5, 10), (25, 10)]), (2.0, 10.0)) is None


def test_against_an_independent_library(spark):
    jvm = spark._jvm
    reader, maker = jvm.org.locationtech.jts.io.WKTReader(), jvm.org.locationtech.jts.operation.polygonize.Polygonizer
    text = lambda points: ", ".join(f"{x} {y}" for x, y in points)
    rng = random.Random(8)
    for _ in range(60):
        turns = sorted(rng.uniform(0, 2 * np.pi) for _ in range(rng.randrange(3, 9)))
        ring = np.array([(100 + 20 * np.cos(t), 50 + 15 * np.sin(t)) for t in turns])
        if len(ring) < 3 or abs(R._area(ring)) < 5:
            continue
        ways = []
        for _ in range(rng.randrange(1, 5)):
            way = [(rng.uniform(70, 130), rng.uniform(25, 75))]
            for _ in range(rng.randrange(1, 5)):
                way.append((way[-1][0] + rng.uniform(-30, 30), way[-1][1] + rng.uniform(-30, 30)))
            ways.append(way)
        if rng.random() < 0.5:
            ways.append([ways[0][0], ways[-1][-1]])
        cell = reader.read(f"POLYGON (({text([*ring, ring[0]])}))")
        union = cell.getBoundary()
        for way in ways:
            union = union.union(reader.read(f"LINESTRING ({text(way)})"))
        polygonizer = maker()
        polygonizer.add(union)
        theirs = [p for p in polygonizer.getPolygons() if cell.covers(p.getInteriorPoint())]
        mine = R.pieces(ring, lines(*ways))
        assert sorted(R.piece_area(p) for p in mine) == pytest.approx(sorted(p.getArea() for p in theirs), abs=1e-5)
        site = (100 + rng.uniform(-8, 8), 50 + rng.uniform(-6, 6))
        point = reader.read(f"POINT ({site[0]} {site[1]})")
        if cell.contains(point):
            held = [p for p in theirs if p.covers(point)]
            expected = max(p.getArea() for p in held) if len(theirs) > 1 else cell.getArea()
            assert R.piece_area(R.piece_of_site(ring, lines(*ways), site)) == pytest.approx(expected, abs=1e-5)


def test_cells_along_roads(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in SQUARE]
    cells = spark.createDataFrame([(1, ring), (2, [{**p, "x": p["x"] + 20} for p in ring]), (3, [])], "sid long, ring array<struct<x:double,y:double>>")
    sites = spark.createDataFrame([(1, 2.0, 2.0), (2, 30.0, 15.0), (3, 0.0, 0.0)], "sid long, sx double, sy double")
    roads = spark.createDataFrame([tuple(map(float, r)) for r in lines([(-5, 5), (10, 5), (10, -5)], [(30, 10), (25, 12)], [(25, 5), (35, 5), (35, 8), (25, 5)])], "ax double, ay double, bx double, by double")
    got = {r["sid"]: r for r in P.road_clipped(cells, sites, roads).collect()}
    assert {k: round(r["area"], 6) for k, r in got.items()} == {1: 50.0, 2: 385.0} and len(got[2]["holes"]) == 1
    assert {k: r["area"] for k, r in ((r["sid"], r) for r in P.road_clipped(cells, sites, roads.limit(0)).collect())} == {1: 400.0, 2: 400.0}
