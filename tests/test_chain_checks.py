from pyspark.sql import functions as F

from plotline.operators import chains as C
from plotline.operators import sequence as Q

ROADS = "key string, way long, nodes array<long>, xs array<double>, ys array<double>, service string"
PLACED = "id long, key string, chain long, side int, at double, house long, head boolean, loop boolean, low double, high double"


def test_bulbs_and_dead_ends(spark):
    rows = [
        ("a", 1, [1, 2], [0.0, 100.0], [0.0, 0.0], None),
        ("a", 2, [2, 3, 4, 2], [100.0, 120.0, 120.0, 100.0], [0.0, 15.0, -15.0, 0.0], None),  # a bulb at the end
        ("b", 3, [1, 9], [0.0, 0.0], [0.0, 80.0], None),  # another street at the start
        ("c", 4, [20, 21], [500.0, 600.0], [0.0, 0.0], None),
        ("d", 5, [21, 22], [600.0, 600.0], [0.0, 50.0], "driveway"),
    ]
    roads = spark.createDataFrame(rows, ROADS)
    got = {r["key"]: r for r in C.dead_ends(C.road_chains(roads), roads).collect()}
    assert got["a"]["nodes"] in ([1, 2, 3, 4, 2], [1, 2, 4, 3, 2]) and got["a"]["loops"] == [False, True, True, True]
    assert not got["a"]["dead_start"] and not got["a"]["dead_end"]  # a street goes on; the run comes back
    assert got["c"]["dead_start"] and got["c"]["dead_end"]  # a driveway does not go on
    assert C.looped([1, 2, 3, 1], {1: (0, 0), 2: (200, 0), 3: (200, 200)}) == [False] * 3


def test_places_along_a_bent_street(spark):
    rows = [("a", 1, [1, 2], [0.0, 100.0], [0.0, 0.0], None), ("a", 2, [3, 2], [100.0, 100.0], [100.0, 0.0], None), ("b", 3, [7, 8], [40.0, 40.0], [4.0, 60.0], None)]
    roads = spark.createDataFrame(rows, ROADS)
    pieces = C.chain_pieces(C.dead_ends(C.road_chains(roads), roads))
    points = [(1, 20.0, 10.0, "a", 5), (2, 110.0, 50.0, "a", 7), (3, 100.0, 130.0, "a", 9), (4, -20.0, 5.0, "a", 11), (5, 39.0, 12.0, "a", 13), (6, 20.0, 1.0, "a", 15), (7, 20.0, -10.0, "a", -1), (8, 20.0, 10.0, "z", 3)]
    df = spark.createDataFrame(points, "id long, x double, y double, ns string, house long")
    got = {r["id"]: r for r in C.placed_on_chains(df, pieces).collect()}
    # 3 has no side, 5 is a corner house, 6 too near, 7 has no number, 8 another street
    assert set(got) == {1, 2, 4} and got[1]["at"] == 20 and got[2]["at"] == 150 and got[4]["at"] == -20 and got[4]["head"] and not got[1]["head"]
    assert got[1]["side"] == -got[2]["side"]
    outlines = spark.createDataFrame([(1, 15.0, 10.0), (1, 32.0, 12.0)], "id long, x double, y double")
    wide = {r["id"]: (r["low"], r["high"]) for r in C.placed_on_chains(df, pieces, outlines).collect()}
    assert wide[1] == (15, 32) and wide[2] == (150, 150)


def placed(spark, rows):
    return spark.createDataFrame([(i, "a", 1, side, float(at), house, head, loop, float(low), float(high)) for i, side, at, house, head, loop, low, high in rows], PLACED)


def test_sequence_and_parity_rules(spark):
    line = [(i, 1, i * 20, 2 * i, False, False, i * 20, i * 20) for i in range(1, 8)]
    swapped = [(i, s, a, {3: 20}.get(i, h), hd, lo, l, u) for i, s, a, h, hd, lo, l, u in line]
    assert [r["id"] for r in Q.out_of_sequence(placed(spark, swapped)).collect()] == [3]
    assert Q.out_of_sequence(placed(spark, swapped), placed(spark, line).where("id > 4")).count() == 0
    beside = [(i, s, a, h, hd, i == 3, l, u) for i, s, a, h, hd, lo, l, u in swapped]
    assert Q.out_of_sequence(placed(spark, beside)).count() == 0
    within = [(i, s, a, h, hd, lo, l, u + (25 if i == 3 else 0)) for i, s, a, h, hd, lo, l, u in swapped]
    assert Q.out_of_sequence(placed(spark, within)).count() == 0  # its stretch covers the neighbour
    odd = line + [(9, 1, 170, 15, True, False, 170, 170), (10, 1, 180, 17, False, False, 180, 180)]
    assert [r["id"] for r in Q.wrong_parity(placed(spark, odd)).collect()] == [10]
    assert 9 not in {r["id"] for r in Q.without_stray_heads(placed(spark, odd)).collect()}
