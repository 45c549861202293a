"""All checks in one list of findings, on a sketch of two streets."""

from pyspark.sql import functions as F

from plotline.functions import address as A
from plotline.operators import chains as C
from plotline.operators import validation as V
from plotline.session import written

ROADS = [(1, "Oak Street", 0.0, 0.0, 4000.0, 0.0), (2, "Elm Street", 0.0, 100.0, 4000.0, 100.0)]


def context(spark, rows, buildings=()):
    """Addresses (id, x, y, number, street) along the roads, and buildings (bid, kind, number, street, box)."""
    roads = spark.createDataFrame(ROADS, "road_id long, name string, ax double, ay double, bx double, by double").withColumn("key", A.normalize_street(F.col("name")))
    ways = roads.select("key", F.col("road_id").alias("way"), F.array(F.col("road_id") * 10, F.col("road_id") * 10 + 1).alias("nodes"), F.array("ax", "bx").alias("xs"), F.array("ay", "by").alias("ys"), F.lit(None).cast("string").alias("service"))
    frame = spark.createDataFrame([(i, float(x), float(y), n, s, None) for i, x, y, n, s in rows], "id long, x double, y double, number string, street string, unit string")
    frame = A.with_normal(frame).withColumn("house", A.leading_number(F.col("number")))
    chains = C.chain_pieces(C.dead_ends(C.road_chains(ways), ways))
    schema = "bid long, building string, factor double, b_number string, b_street string, b_unit string, b_exact string, bxmin double, bymin double, bxmax double, bymax double"
    built = spark.createDataFrame([(b, k, 0.1 if k == "garage" else 1.0, n, s, None, n and f"{n}{s}", *map(float, box)) for b, k, n, s, box in buildings], schema)
    return {"addresses": frame, "roads": roads, "buildings": A.with_normal(built, "b_"), "placed": written(C.placed_on_chains(frame, written(chains, "pieces")), "placed")}


def row(k, number, street="Oak Street", y=20):
    return (k, 40 + 20 * k, y, str(number), street)


def listed(found):
    return sorted((r["code"], r["element"], r["detail"], tuple(r["related"])) for r in found.collect())


def test_numbers_along_the_street(spark):
    rows = [row(k, n) for k, n in enumerate((100, 102, 150, 106, 108, 111, 112, 114, 116, 118))]
    c = context(spark, rows)
    assert listed(V.house_numbers(c["placed"], c["addresses"])) == [
        (V.SEQUENCE, "n2", "150 between 102 and 106 on Oak Street", ("n1", "n3")),
        (V.PARITY, "n5", "111 on the even side of Oak Street", ()),
    ]
    placed, addresses = c["placed"], c["addresses"]
    assert [r[0] for r in listed(V.house_numbers(placed, addresses, parity=False))] == [V.SEQUENCE]
    edge = spark.createDataFrame([(-500.0, -500.0, 150.0, 500.0)], "dxmin double, dymin double, dxmax double, dymax double")
    assert {r["element"]: r["message"].endswith(V.AT_EDGE) for r in V.house_numbers(placed, addresses, edge).collect()} == {"n2": True, "n5": True}
    inside = spark.createDataFrame([(-500.0, -500.0, 900.0, 500.0)], edge.schema)
    assert not any(r["message"].endswith(V.AT_EDGE) for r in V.house_numbers(placed, addresses, inside).collect())


def test_only_what_was_visited(spark):
    c = context(spark, [row(k, n) for k, n in enumerate((100, 102, 150, 106, 108, 111, 112, 114, 116, 118))], [(5, "garage", "9", "Oak Street", (300, 40, 306, 46))])
    visited = spark.createDataFrame([("n5",), ("b5",)], "element string")
    assert [r[1] for r in listed(V.findings(**c, visited=visited))] == ["b5", "n5"]


def test_streets(spark):
    rows = [row(1, 10, "Oak St."), row(2, 12, "Pine Road"), (3, 5000.0, 20.0, "14", "Oak Street"), row(4, 16, "Oak Street;Fir Lane")]
    c = context(spark, rows)
    got = listed(V.unknown_streets(c["addresses"], c["roads"]))
    assert got == [
        (V.NO_ROAD, "n2", "addr:street=Pine Road", ()), (V.NO_ROAD, "n3", "addr:street=Oak Street", ()), (V.NO_ROAD, "n4", "addr:street=Fir Lane", ()),
        (V.NEAR_MATCH, "n1", "addr:street=Oak St., road name=Oak Street", ("w1",)),
    ]


CASES = [
    (["Oak Street"] * 5, "Oak Street", "Oak Street"),
    (["Oak Street", "Oak St", "Oak St", "Oak St", "Oak St"], "Oak St", "Oak St"),
    (["Oak Street", "Oak St", "Oak Street", "Oak St", "Oak St"], "Oak St", None),
    (["Oak St", "Oak Street", "Oak St", "Oak Street"], "Oak Street", None),  # of equals the nearest one's
]


def test_neighbours_and_their_spelling(spark):
    """An address of Elm Street among ones of Oak Street on that street, as spelled."""
    rows, expected, fixes = [], [], []
    for c, (spellings, said, fixed) in enumerate(CASES):
        x, first = 800 * c, 100 * c
        rows += [(first + k, x + 40 + 20 * k, 20, str(10 + 2 * k), s) for k, s in enumerate(spellings)] + [(first + 50, x + 95, 21, "77", "Elm Street")]
        near = tuple(sorted(f"n{first + k}" for k in range(len(spellings)) if abs(40 + 20 * k - 95) < 60))
        expected.append((V.NEIGHBOURS, f"n{first + 50}", f"addr:street=Elm Street, neighbours use {said}", near))
        fixes += [(first + 50, "Elm Street", fixed)] if fixed else []
    c = context(spark, rows)
    assert listed(V.unlike_neighbours(c["addresses"], c["roads"])) == sorted(expected)
    assert sorted((r["id"], r["was"], r["street"]) for r in V.street_fixes(c["addresses"], c["roads"]).collect()) == fixes


def test_buildings(spark):
    rows = [(1, 55.0, 45.0, "10", "Oak Street"), (2, 100.0, 45.0, "12", None)]
    built = [(5, "garage", "9", "Oak Street", (300, 40, 306, 46)), (6, "house", "11", "Oak Street", (50, 40, 60, 50)), (7, "house", "12", "Elm Street", (95, 40, 105, 50))]
    c = context(spark, rows, built)
    got = [r for r in listed(V.findings(**c)) if r[0] in (V.OUTBUILDING, V.DIFFERS)]
    assert got == [
        (V.OUTBUILDING, "b5", "building=garage carries an address but no amenity, shop or office tag", ()),
        (V.DIFFERS, "n1", "node 10 Oak Street, building 11 Oak Street", ("b6",)),
    ]
    assert V.findings(**context(spark, [])).count() == 0


def test_first_of_each(spark):
    found = spark.createDataFrame([(1, "n1", "b"), (1, "n1", "a"), (2, "n1", "c")], "code int, element string, detail string")
    assert sorted((r["code"], r["detail"], r["n"]) for r in V.first_of_each(found).collect()) == [(1, "a", 2), (2, "c", 1)]
