"""The match on small sketches in metres: boxes for parcels and buildings, points for addresses."""

import pytest
from pyspark.sql import functions as F

from plotline.functions import address as A
from plotline.operators import match as M
from plotline.operators.settings import MatchSettings, bucket_rank

SETTINGS = MatchSettings()


def rect(cx, cy, w, h):
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def run(spark, addresses, parcels, buildings, existing=(), settings=SETTINGS):
    """Proposals by address id: (bucket, target, confidence)."""

    def exact(a):
        return ";".join(str(x) for x in a)

    a = spark.createDataFrame(
        [(i, float(x), float(y), *t, None, exact(t)) for i, x, y, *t in addresses], "id long, x double, y double, number string, street string, unit string, place string, exact string"
    )
    c = spark.createDataFrame([(f"P{i}", *map(float, rect(*r))) for i, r in enumerate(parcels)], "cell_id string, cxmin double, cymin double, cxmax double, cymax double")
    b = spark.createDataFrame(
        [(i, kind, *map(float, rect(*r)), *(t or (None, None, None)), None, exact(t) if t else None) for i, kind, r, t in buildings],
        "bid long, building string, bxmin double, bymin double, bxmax double, bymax double, b_number string, b_street string, b_unit string, b_place string, b_exact string",
    ).withColumn("factor", settings.building_weight(F.col("building")))
    e = spark.createDataFrame([(i, float(x), float(y), *t, None, exact(t)) for i, x, y, *t in existing], "eid long, ex double, ey double, e_number string, e_street string, e_unit string, e_place string, e_exact string")
    out = M.match_addresses(A.with_normal(a), c, A.with_normal(b, "b_"), A.with_normal(e, "e_"), settings)
    return {r["id"]: r for r in M.ordered(out).collect()}


OAK = ("10", "Oak Ave", None)
ELM = ("12", "Oak Ave", None)
LOT = (0, 0, 40, 60)


def test_house_beats_garage(spark):
    got = run(spark, [(1, 0, 0, *OAK)], [LOT], [(1, "house", (0, 15, 12, 10), None), (2, "garage", (0, -18, 7, 6), None)])[1]
    assert (got["bucket"], got["target"]) == ("CLEAN", 1) and got["confidence"] > 0.9


def test_point_inside_the_garage_still_goes_to_the_house(spark):
    assert run(spark, [(1, 0, 0, *OAK)], [LOT], [(1, "garage", (0, 0, 7, 6), None), (2, "house", (0, 18, 12, 10), None)])[1]["target"] == 2


@pytest.mark.parametrize(("height", "bucket"), [(3, "CLEAN"), (8.4, "AMBIGUOUS_BUILDING")])
def test_runner_up(spark, height, bucket):
    assert run(spark, [(1, 0, 0, *OAK)], [LOT], [(1, "yes", (0, 15, 12, 10), None), (2, "yes", (0, -15, 12, height), None)])[1]["bucket"] == bucket


def test_two_addresses_and_two_houses(spark):
    got = run(spark, [(1, 0, 0, *OAK), (2, 1, 0, *ELM)], [LOT], [(1, "house", (8, 0, 10, 10), None), (2, "house", (-8, 0, 10, 10), None)])
    assert {r["bucket"] for r in got.values()} == {"AMBIGUOUS_BUILDING"}


def test_a_row_over_three_parcels(spark):
    parcels = [(x, 0, 10, 40) for x in (-10, 0, 10)]
    got = run(spark, [(i, x, -15, str(i), "Oak Ave", None) for i, x in enumerate((-10, 0, 10))], parcels, [(1, "terrace", (0, 0, 28, 12), None)])
    assert {r["bucket"] for r in got.values()} == {"REVIEW"} and len(got) == 3


def test_duplicates_in_and_across_parcels(spark):
    house = [(1, "house", (0, 0, 10, 10), None)]
    same = run(spark, [(1, 0, 0, *OAK), (2, 1, 0, *OAK)], [LOT], house)
    assert list(same) == [1] and same[1]["bucket"] == "CLEAN"
    across = run(spark, [(1, 0, 0, *OAK), (2, 41, 0, *OAK)], [LOT, (40, 0, 40, 60)], house)
    assert {r["bucket"] for r in across.values()} == {"DUPLICATE"} and len(across) == 2


@pytest.mark.parametrize(("reach", "bucket"), [(30.0, "CLEAN"), (4.0, "OUTSIDE_CELLS")])
def test_snap(spark, reach, bucket):
    got = run(spark, [(1, 26, 0, *OAK)], [LOT], [(1, "house", (0, 0, 10, 10), None)], settings=MatchSettings(match_distance=reach))[1]
    assert got["bucket"] == bucket


def test_existing_addresses(spark):
    house = [(1, "house", (0, 0, 10, 10), None)]
    unit = run(spark, [(1, 0, 12, *OAK)], [LOT], house, [(9, 0, 20, "10", "Oak Ave", "3")])[1]
    assert (unit["bucket"], unit["kind"]) == ("EXISTING_ADDRESS", "UNIT_DIFF")
    other = run(spark, [(1, 0, 12, *OAK)], [LOT], [(1, "house", (0, 0, 10, 10), ("99", "Elm St", None))])[1]
    assert (other["bucket"], other["kind"]) == ("EXISTING_ADDRESS", "OTHER_ADDRESS_ON_BUILDING")
    same = run(spark, [(1, 0, 12, *OAK)], [LOT], house, [(9, 0, 20, *OAK)])[1]
    assert (same["bucket"], same["kind"], same["confidence"]) == ("CLEAN", "IDENTICAL", 0.95)
    partial = run(spark, [(1, 0, 12, *OAK)], [LOT], house, [(9, 0, 20, "10", None, None)])[1]
    assert partial["bucket"] == "FILL_EXISTING"


def test_free_neighbour_of_an_addressed_building(spark):
    got = run(spark, [(1, 0, 0, *OAK)], [LOT], [(1, "house", (0, 15, 14, 10), ("8", "Oak Ave", None)), (2, "house", (0, -15, 12, 10), None)])[1]
    assert (got["bucket"], got["target"]) == ("CLEAN", 2)


def test_no_building_and_lone_unit(spark):
    assert run(spark, [(1, 0, 0, *OAK)], [LOT], [(1, "house", (200, 0, 10, 10), None)])[1]["bucket"] == "NO_BUILDING"
    unit = run(spark, [(1, 0, 0, "10", "Oak Ave", "Apt 3")], [LOT], [(1, "house", (0, 0, 10, 10), None)])[1]
    assert unit["bucket"] == "REVIEW" and unit["keeps_node"]


def test_shared_footprint(spark):
    got = run(spark, [(1, 0, 0, *OAK)], [LOT], [(1, "house", (0, 0, 10, 10), None)], [(9, 2, 2, "77", "Oak Ave", None)])[1]
    assert got["bucket"] == "MULTI_ADDRESS_BUILDING" and got["keeps_node"]


def test_canopy_with_a_feature(spark):
    tags = spark.createDataFrame([({"building": "roof", "amenity": "fuel"},), ({"building": "roof"},), ({"building": "shed", "amenity": "bench"},), ({"building": "house"},)], "tags map<string,string>")
    assert [r[0] for r in tags.select(SETTINGS.tag_weight(F.col("tags"))).collect()] == [1.0, 0.02, 0.1, 1.0]


def test_order_of_buckets(spark):
    df = spark.createDataFrame([("CLEAN",), ("OUTSIDE_CELLS",)], "b string")
    assert [r[0] for r in df.select(bucket_rank(F.col("b"))).collect()] == [0, 8]
