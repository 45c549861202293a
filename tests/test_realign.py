"""Layers that lie beside each other, on a sketch of lots with a house each."""

import math

from pyspark.sql import functions as F

from plotline.functions import address as A
from plotline.functions.shapes import with_rings
from plotline.operators import realign as R
from plotline.operators.settings import MatchSettings

LOTS = [(k, 30.0 * (k % 8), 40.0 * (k // 8)) for k in range(40)]


def lots(spark, east=0.0, north=0.0):
    return spark.createDataFrame([(f"P{k}", x + east, y + north, x + 30 + east, y + 40 + north) for k, x, y in LOTS], "cell_id string, cxmin double, cymin double, cxmax double, cymax double")


def houses(spark):
    rows = [(k, "house", 1.0, x + 1, y + 1, x + 29, y + 39, None, None, None, None, None) for k, x, y in LOTS]
    names = "bid long, building string, factor double, bxmin double, bymin double, bxmax double, bymax double, b_number string, b_street string, b_unit string, b_place string, b_exact string"
    return A.with_normal(spark.createDataFrame(rows, names), "b_")


def points(spark, east=0.0, north=0.0):
    rows = [(k, x + 15 + east, y + 20 + north, str(k), "Oak Street", None, None, f"k{k}") for k, x, y in LOTS]
    return A.with_normal(spark.createDataFrame(rows, "id long, x double, y double, number string, street string, unit string, place string, exact string"))


def shifts(done):
    return {(r["round"], r["layer"]): (r["dx"], r["dy"], r["significant"], r["moved"]) for r in done.shifts.collect()}


def test_both_layers_are_moved(spark):
    done = R.settle(points(spark, -9.0, 5.0), lots(spark, 4.0, -3.0), houses(spark), settings=MatchSettings())
    found = shifts(done)
    assert found[0, R.ADDRESSES] == (9.0, -5.0, True, True)
    # the parcels hold the houses' outlines once they are within a metre of their place
    dx, dy, significant, moved = found[0, R.PARCELS]
    assert (dx, dy) == (-3.0, 2.0) and significant and moved
    assert found[1, R.ADDRESSES] == (0.0, 0.0, False, False) and not found[1, R.PARCELS][2] and (2, R.ADDRESSES) not in found
    assert {(r["id"], r["bucket"]) for r in done.proposals.collect()} == {(k, "CLEAN") for k, _, _ in LOTS}
    assert {(r["x"] - 15) % 30 for r in done.addresses.collect()} == {0.0} and done.cells.agg(F.min("cxmin")).first()[0] == 1.0


def test_what_is_declined_stays(spark):
    done = R.settle(points(spark, -9.0, 5.0), lots(spark, 4.0, -3.0), houses(spark), declined=(R.ADDRESSES, R.PARCELS))
    found = shifts(done)
    assert set(found) == {(0, R.ADDRESSES), (0, R.PARCELS)} and not any(f[3] for f in found.values()) and all(f[2] for f in found.values())
    assert done.addresses.agg(F.min("x")).first()[0] == 6.0


def test_a_layer_of_repeated_addresses_is_measured_too(spark):
    # as on a map of many towns: every address lies in two cells, so that none is clean
    repeated = points(spark, -9.0, 5.0).withColumn("exact", F.concat(F.lit("k"), (F.col("id") % 20).cast("string")))
    done = R.settle(repeated, lots(spark), houses(spark), settings=MatchSettings())
    assert shifts(done)[0, R.ADDRESSES] == (9.0, -5.0, True, True) and shifts(done)[1, R.ADDRESSES] == (0.0, 0.0, False, False)
    assert {(r["id"], r["bucket"]) for r in done.proposals.collect()} == {(k, "DUPLICATE") for k, _, _ in LOTS}


def test_shapes_move_whole(spark):
    ring = [(0.0, 0.0), (6.0, 0.0), (6.0, 4.0), (0.0, 0.0)]
    made = with_rings(spark.createDataFrame([(1, [ring])], "cell_id long, r array<array<struct<x:double,y:double>>>"), F.col("r"), "c").drop("r")
    moved = R.moved_shapes(made, "c", 2.0, -1.0).first()
    again = with_rings(spark.createDataFrame([(1, [[(x + 2, y - 1) for x, y in ring]])], "cell_id long, r array<array<struct<x:double,y:double>>>"), F.col("r"), "c").drop("r").first()
    assert moved.asDict(True) == again.asDict(True)


def along(ring, apart, most):
    """Points along a ring, walked edge by edge."""
    total = sum(math.dist(a, b) for a, b in zip(ring, ring[1:]))
    step, carry, out = max(apart, total / most), 0.0, []
    for a, b in zip(ring, ring[1:]):
        length, t = math.dist(a, b), carry
        while t < length - 1e-9:
            out.append((a[0] + t / length * (b[0] - a[0]), a[1] + t / length * (b[1] - a[1])))
            t += step
        carry = t - length
    return out


def test_points_along_outlines(spark):
    house = [(0.0, 0.0), (7.5, 0.0), (7.5, 3.2), (2.0, 6.0), (0.0, 0.0)]
    hall = [(100.0, 0.0), (400.0, 0.0), (400.0, 100.0), (100.0, 100.0), (100.0, 0.0)]
    yard = [(150.0, 20.0), (150.0, 40.0), (170.0, 40.0), (150.0, 20.0)]
    shapes = spark.createDataFrame([(1, [house]), (2, [hall, yard]), (3, [])], "bid long, rings array<array<struct<x:double,y:double>>>")
    got = {}
    for r in R.outline_points(shapes, "bid", F.col("rings")).collect():
        got.setdefault(r["bid"], []).append((r["x"], r["y"]))
    assert set(got) == {1, 2} and len(got[2]) == 120
    for bid, ring in ((1, house), (2, hall)):
        rounded = [sorted((round(x, 6), round(y, 6)) for x, y in points) for points in (got[bid], along(ring, 1.0, 120))]
        assert rounded[0] == rounded[1]
