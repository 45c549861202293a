"""Commands that apply proposals, on sketches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.functions.shapes import rings_centroid, with_interior_point
from plotline.operators import apply as P
from plotline.operators import placing

SHOWN = "id long, bucket string, target_layer string, target long, kind string, keeps_node boolean, found_key string, found_tags map<string,string>"
GROUPS = "id long, x double, y double, tags map<string,string>, dup_ids array<long>"
RINGS = "layer string, fid long, rings array<array<struct<x:double,y:double>>>, fx double, fy double"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


L_SHAPE = [(0.0, 0.0), (20.0, 0.0), (20.0, 4.0), (4.0, 4.0), (4.0, 20.0), (0.0, 20.0), (0.0, 0.0)]
FEATURES = [
    ("building", 1, [box(0.0, 0.0, 10.0, 10.0)], None, None),
    ("building", 2, [box(20.0, 0.0, 60.0, 40.0), box(32.0, 12.0, 48.0, 28.0)], None, None),
    ("hint", 3, [L_SHAPE], None, None),
    ("hint", 4, [box(100.0, 0.0, 110.0, 20.0)], None, None),
    ("node", 5, [[(206.0, 0.0), (200.0, 6.0), (194.0, 0.0), (200.0, -6.0), (206.0, 0.0)]], 200.0, 0.0),
    ("node", 6, [[(306.0, 0.0), (300.0, 6.0), (294.0, 0.0), (300.0, -6.0), (306.0, 0.0)]], 300.0, 0.0),
]


def run(spark, proposals, points, features=FEATURES, **more):
    """Commands as (proposal, step, layer, op, pkey, tags, place) for proposals
    (id, bucket, layer, target, kind, keeps, found key, found tags) and points id -> (x, y, dups, unit)."""
    groups = []
    for i, (x, y, *rest) in points.items():
        tags = {"addr:housenumber": str(i), "source": "s"}
        if len(rest) > 1:
            tags["addr:unit"] = rest[1]
        groups.append((i, x, y, tags, rest[0] if rest else []))
    frames = {k: spark.createDataFrame(*v) if isinstance(v, tuple) else v for k, v in more.items()}
    out = P.commands(spark.createDataFrame(proposals, SHOWN), spark.createDataFrame(groups, GROUPS), spark.createDataFrame(features, RINGS), **frames)
    rows = [(r["proposal"], r["step"], r["layer"], r["op"], r["pkey"], r["tags"], None if r["x"] is None else (r["x"], r["y"])) for r in out.collect()]
    return sorted(rows, key=lambda r: (r[0], r[1], r[4]))


def proposal(i, bucket, layer=None, target=None, kind=None, keeps=False, key=None, tags=None):
    return (i, bucket, layer, target, kind, keeps, key, tags)


ALONE = {7: (5.0, 5.0, [8, 9])}
FOUND = {i: (0.0, 0.0) for i in range(11, 17)}
SEVERAL = {21: (22.0, 2.0), 22: (22.1, 2.0), 23: (40.0, 20.0)}
HINTED = {31: (101.0, 1.0), 32: (19.0, 1.0)}
BESIDE = {41: (203.0, 0.0), 42: (250.0, 0.0), 43: (303.0, 0.0)}


@pytest.fixture(scope="module")
def done(spark):
    """Commands of the sketches that don't touch each other, by proposal."""
    rows = [proposal(7, "CLEAN", "building", 1)]
    rows += [proposal(11, "FILL_EXISTING", None, None, "PARTIAL", key="e4", tags={"addr:unit": "1"}), proposal(12, "CLEAN", "building", 1, "IDENTICAL", key="b1", tags={"addr:housenumber": "x"})]
    rows += [proposal(13, "EXISTING_ADDRESS", None, None, "IDENTICAL", key="e5", tags={}), proposal(14, "EXISTING_ADDRESS", None, None, "UNIT_DIFF"), proposal(15, "DUPLICATE"), proposal(16, "OUTSIDE_CELLS")]
    rows += [proposal(i, "MULTI_ADDRESS_BUILDING", "building", 2) for i in (21, 22, 23)]
    rows += [proposal(31, "CLEAN", "hint", 4), proposal(32, "CLEAN", "hint", 3)]
    rows += [proposal(i, "MULTI_ADDRESS_BUILDING", "node", 5) for i in (41, 42)] + [proposal(43, "CLEAN", "node", 6)]
    return run(spark, rows, ALONE | FOUND | SEVERAL | HINTED | BESIDE)


def test_alone_on_a_building_tags_it_and_goes(done):
    got = [r for r in done if r[0] == 7]
    assert got == [(7, 1, "target", "set_tags", "b1", {"addr:housenumber": "7"}, None)] + [(7, 2, "source", "delete_node", f"n{i}", {}, None) for i in (7, 8, 9)]


def test_what_has_the_address_gets_what_it_lacks(done):
    assert [(r[0], r[3], r[4], r[5]) for r in done if r[0] in FOUND] == [
        (11, "set_tags", "e4", {"addr:housenumber": "11"}), (11, "delete_node", "n11", {}), (12, "delete_node", "n12", {}), (13, "delete_node", "n13", {}),
    ]


def test_several_on_a_building_become_nodes_in_it(done):
    got = [r for r in done if r[0] in SEVERAL and r[1] == 1]
    assert {r[0] for r in got} == {21} and [r[4] for r in got] == ["n21", "n22", "n23"] and got[0][6] == (22.0, 2.0)
    for r in got[1:]:
        x, y = r[6]
        assert 20 < x < 60 and 0 < y < 40 and not (32 <= x <= 48 and 12 <= y <= 28)
    assert math.dist(got[1][6], got[2][6]) >= 2


def test_hints_get_nodes_and_one_stands_in_the_middle(done):
    at = {r[0]: r[6] for r in done if r[1] == 1}
    assert at[31] == (105.0, 10.0)
    x, y = at[32]  # the centre of mass of the angle lies outside it
    assert (0 < x < 20 and 0 < y < 4) or (0 < x < 4 and 0 < y < 20)


def test_beside_a_building_node(done):
    at = {r[4]: r for r in done if r[1] == 1}
    # the spot east of the node is too near to the address that stayed
    assert at["n41"][6] == (203.0, 0.0) and at["n42"][6] == pytest.approx((200 + math.sqrt(2), math.sqrt(2)))
    assert at["m6"][3] == "set_tags" and at["m6"][0] == 43


def test_another_address_in_the_footprint_keeps_the_node(spark):
    """Alike buildings with an address node inside, on the border, on the outline, and of their own."""
    features = FEATURES + [("building", 100 + k, [box(1000.0 * k, 0.0, 1000.0 * k + 10, 10.0)], None, None) for k in range(4)]
    rows = [proposal(100 + k, "CLEAN", "building", 100 + k) for k in range(4)]
    points = {100: (2.0, 2.0), 101: (1002.0, 2.0), 102: (2002.0, 2.0), 103: (3002.0, 2.0, [8])}
    here = [(50, 5.0, 5.0, False), (51, 1010.0, 5.0, False), (52, 2005.0, 5.0, False), (103, 3002.0, 2.0, True), (8, 3002.0, 2.5, True)]
    more = {"here": (here, "node_id long, hx double, hy double, source boolean"), "outline": ([("building", 102, 52)], "layer string, fid long, node_id long")}
    got = {r[0]: r for r in run(spark, rows, points, features=features, **more) if r[1] == 1}
    assert got[100][3:] == ("add_node", "n100", {"addr:housenumber": "100"}, (2.0, 2.0))
    assert [got[k][3] for k in (101, 102, 103)] == ["set_tags"] * 3


def test_in_one_layer_nodes_move_and_duplicates_go(spark):
    rows = [proposal(i, "MULTI_ADDRESS_BUILDING", "building", 1) for i in (1, 2)] + [proposal(3, "NO_BUILDING")]
    got = run(spark, rows, {1: (5.0, 5.0, [11]), 2: (30.0, 5.0), 3: (90.0, 90.0, [13])}, same_layer=True)
    assert [r[3:5] for r in got] == [("move_node", "n2"), ("delete_node", "n11"), ("delete_node", "n13")] and {r[2] for r in got} == {"target"}
    kept = run(spark, rows, {1: (5.0, 5.0, [11]), 2: (30.0, 5.0), 3: (90.0, 90.0, [13])}, delete_sources=False)
    assert [r[3:5] for r in kept] == [("add_node", "n1"), ("add_node", "n2"), ("add_node", "n3")]


def test_nodes_that_are_gone(spark):
    live = ([(2,), (3,)], "node_id long")
    rows = [proposal(i, "MULTI_ADDRESS_BUILDING", "building", 1) for i in (1, 2)] + [proposal(4, "CLEAN", "building", 2)]
    got = run(spark, rows, {1: (5.0, 5.0), 2: (6.0, 6.0, [9]), 4: (25.0, 5.0)}, live=live)
    # the other one is still a node, though it now is the only one left
    assert [r[3:5] for r in got] == [("add_node", "n2"), ("delete_node", "n2")]


def test_picks(spark):
    picks = ([(1, "building", 1), (3, "building", 2), (4, "building", 2)], "id long, layer string, fid long")
    rows = [proposal(1, "AMBIGUOUS_BUILDING"), proposal(2, "AMBIGUOUS_BUILDING"), proposal(3, "REVIEW", "building", 1, keeps=True), proposal(4, "REVIEW", "hint", 4, keeps=True)]
    got = [r for r in run(spark, rows, {1: (0.0, 0.0), 2: (0.0, 0.0), 3: (25.0, 5.0), 4: (25.0, 9.0, [], "B")}, picks=picks) if r[1] == 1]
    # another building frees an address from its footprint's others, but not a lone unit
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "set_tags", "b1"), (3, "set_tags", "b2"), (4, "add_node", "n4")]


def test_no_proposals(spark):
    assert run(spark, [], {1: (0.0, 0.0)}) == []


def by_definition(points, rings, middle):
    """The rule as stated, comparing every place with all taken."""
    inside, taken = placing.strictly_inside(rings), []
    for p in points:
        clear = lambda q, d: all(math.dist(q, t) >= d for t in taken)  # noqa: B023, E731
        spots = [(middle[0] + 3 * i, middle[1] + 3 * j) for r in range(1, 40) for i in range(-r, r + 1) for j in range(-r, r + 1) if max(abs(i), abs(j)) == r]
        if inside(p) and clear(p, 0.5):
            taken.append(p)
        elif clear(middle, 2):
            taken.append(middle)
        else:
            taken.append(next((q for q in spots if inside(q) and clear(q, 2)), middle))
    return taken


def test_places_by_definition():
    rng = np.random.default_rng(5)
    rings = [np.array(box(0, 0, 30, 18), float), np.array(box(10, 5, 20, 12), float)]
    points = [(float(x), float(y)) for x, y in rng.integers(-4, 34, (70, 2)) / 2]
    for middle in ((5.0, 9.0), (15.0, 2.0)):
        assert placing.place_inside(points, rings, middle) == by_definition(points, rings, middle)
    small = [np.array(box(0, 0, 3, 3), float)]
    assert placing.place_inside([(9.0, 9.0)] * 5, small, (1.5, 1.5)) == [(1.5, 1.5)] * 5


def test_places_do_not_depend_on_batches(spark):
    rows = [(i, i % 3, float(i % 7), float(i % 5)) for i in range(90)]
    frame = spark.createDataFrame(rows, "id long, bid long, x double, y double").withColumns({f"b{k}": F.lit(v) for k, v in {"xmin": 0.0, "ymin": 0.0, "xmax": 40.0, "ymax": 30.0}.items()})
    expected = {}
    for b in range(3):
        own = [r for r in rows if r[1] == b]
        expected |= dict(zip((r[0] for r in own), by_definition([r[2:] for r in own], [np.array(box(0, 0, 40, 30), float)], (20.0, 15.0))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r["id"]: (r["px"], r["py"]) for r in placing.placed(frame).collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_centre_of_mass_with_holes(spark):
    rings = spark.createDataFrame([(1, [box(0.0, 0.0, 10.0, 10.0), box(6.0, 0.5, 9.0, 9.5)])], "fid long, rings array<array<struct<x:double,y:double>>>")
    row = with_interior_point(rings.withColumn("c", rings_centroid(F.col("rings"))), "rings", "p").first()
    assert row["c"]["x"] == pytest.approx((100 * 5 - 27 * 7.5) / 73) and row["c"]["y"] == pytest.approx(5)
    assert (row["p"]["x"], row["p"]["y"]) == (3.0, 5.0) or row["p"]["x"] < 6
