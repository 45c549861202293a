"""Building nodes and hints on sketches in metres."""

import math

import pytest
from pyspark.sql import functions as F

from plotline.functions import address as A
from plotline.operators import placing
from plotline.operators import stand_ins as S
from plotline.operators.settings import MatchSettings
from tests.test_match import ELM, LOT, OAK, rect

SETTINGS = MatchSettings()


#: Each sketch: addresses, then what else lies there. All are matched at once, a kilometre apart.
SKETCHES = {
    "one node": dict(addresses=[(1, 0, 0, *OAK)], nodes=[(7, 5, 5)]),
    "two addresses": dict(addresses=[(1, 0, 0, *OAK), (2, 3, 0, *ELM)], nodes=[(7, 5, 5)]),
    "two nodes": dict(addresses=[(1, 0, 0, *OAK)], nodes=[(7, 5, 5), (8, -5, 5)]),
    "node and hint": dict(addresses=[(1, 0, 0, *OAK)], nodes=[(7, 5, 5)], hints=[(3, (0, 0, 10, 10))]),
    "outline": dict(addresses=[(1, 0, 0, *OAK)], buildings=[(4, "house", (0, 10, 10, 10))], nodes=[(7, 5, -5)], hints=[(3, (0, -10, 10, 10))]),
    "one hint": dict(addresses=[(1, 0, 0, *OAK)], hints=[(3, (0, 0, 10, 10))]),
    "shared hint": dict(addresses=[(1, 0, 0, *OAK), (2, 3, 0, *ELM)], hints=[(3, (0, 0, 10, 10))]),
    "close hints": dict(addresses=[(1, 0, 0, *OAK)], hints=[(3, (0, 15, 10, 10)), (5, (0, -15, 10, 9))]),
    "split hint": dict(addresses=[(1, 15, 0, *OAK)], hints=[(3, (20, 0, 20, 10))]),
    "large hint": dict(addresses=[(1, 0, 0, *OAK)], buildings=[(4, "shed", (0, 20, 8, 8))], hints=[(3, (0, -15, 10, 10))]),
    "small hint": dict(addresses=[(1, 0, 0, *OAK)], buildings=[(4, "shed", (0, 20, 8, 8))], hints=[(3, (0, -15, 4, 4))]),
    "existing": dict(addresses=[(1, 0, 12, *OAK)], nodes=[(7, 5, 5)], hints=[(3, (0, 0, 10, 10))], existing=[(9, 0, 20, *OAK)]),
    "nothing": dict(addresses=[(1, 0, 0, *OAK)]),
}


@pytest.fixture(scope="module")
def got(spark):
    """Of each sketch: (bucket, target_layer, target, confidence) and kind by address id."""
    exact = lambda t: ";".join(str(x) for x in t)
    addresses, parcels, buildings, existing, nodes, hints = [], [], [], [], [], []
    for k, s in enumerate(SKETCHES.values()):
        at, own = 1000.0 * k, 100 * k
        box = lambda r: (float(v) for v in rect(r[0] + at, *r[1:]))  # noqa: E731, B023
        tags = lambda t: (f"{k}-{t[0]}", *t[1:])  # noqa: E731, B023
        parcels.append((f"P{k}", *box(LOT)))
        addresses += [(own + i, at + x, float(y), *tags(t), None, exact(tags(t))) for i, x, y, *t in s["addresses"]]
        existing += [(own + i, at + x, float(y), *tags(t), None, exact(tags(t))) for i, x, y, *t in s.get("existing", ())]
        buildings += [(own + i, kind, *box(r), None, None, None, None, None) for i, kind, r in s.get("buildings", ())]
        nodes += [(own + i, at + x, float(y)) for i, x, y in s.get("nodes", ())]
        hints += [(own + i, 1.0, *box(r)) for i, r in s.get("hints", ())]
    a = spark.createDataFrame(addresses, "id long, x double, y double, number string, street string, unit string, place string, exact string")
    c = spark.createDataFrame(parcels, "cell_id string, cxmin double, cymin double, cxmax double, cymax double")
    b = spark.createDataFrame(buildings, "bid long, building string, bxmin double, bymin double, bxmax double, bymax double, b_number string, b_street string, b_unit string, b_place string, b_exact string")
    b = b.withColumn("factor", SETTINGS.building_weight(F.col("building")))
    e = spark.createDataFrame(existing, "eid long, ex double, ey double, e_number string, e_street string, e_unit string, e_place string, e_exact string")
    m = spark.createDataFrame(nodes, "node_id long, mx double, my double")
    h = spark.createDataFrame(hints, "hint_id long, factor double, hxmin double, hymin double, hxmax double, hymax double")
    out = {name: {} for name in SKETCHES}
    names = list(SKETCHES)
    for r in S.match_with_stand_ins(A.with_normal(a), c, A.with_normal(b, "b_"), A.with_normal(e, "e_"), m, h, SETTINGS).collect():
        target = None if r["target"] is None else r["target"] % 100
        out[names[r["id"] // 100]][r["id"] % 100] = ((r["bucket"], r["target_layer"], target, r["confidence"]), r["kind"])
    return out


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("one node", ("CLEAN", "node", 7, 0.85)),
        ("two addresses", ("MULTI_ADDRESS_BUILDING", "node", 7, 0.7)),
        ("two nodes", ("AMBIGUOUS_BUILDING", "node", None, 0.3)),
        ("node and hint", ("CLEAN", "node", 7, 0.85)),
        ("outline", ("CLEAN", "building", 4, 1.0)),
        ("one hint", ("CLEAN", "hint", 3, 0.8)),
        ("shared hint", ("REVIEW", "hint", 3, 0.6)),
        ("close hints", ("AMBIGUOUS_BUILDING", "hint", 3, 0.4)),
        ("split hint", ("REVIEW", "hint", 3, 0.6)),
        ("large hint", ("CLEAN", "hint", 3, 0.8)),
        ("small hint", ("CLEAN", "building", 4, 1.0)),
        ("nothing", ("NO_BUILDING", None, None, 0.9)),
    ],
)
def test_sketches(got, name, want):
    assert len(got[name]) == len(SKETCHES[name]["addresses"])
    assert {found for found, _ in got[name].values()} == {want}


def test_existing_addresses_come_first(got):
    assert got["existing"][1] == (("CLEAN", None, None, 0.95), "IDENTICAL")


def test_places_beside_a_node(spark):
    node = (10.0, 10.0)
    own, stacked, far = placing.place_beside([(12.0, 12.0), (12.1, 12.1), (90.0, 90.0)], node)
    assert own == (12.0, 12.0)
    assert stacked == (12.0, 10.0)
    spots = placing.place_beside([node] * 25, node)
    assert all(math.dist(a, b) >= 2 - 1e-9 for i, a in enumerate(spots[:8]) for b in spots[:i]) and math.dist(spots[0], node) == 2
    assert math.dist(far, node) <= 6 + 1e-9
    rows = [(i, 7, 10.0, 10.0, *node) for i in range(3)] + [(9, 8, 1.0, 1.0, 0.0, 0.0)]
    got = placing.placed_beside(spark.createDataFrame(rows, "id long, node_id long, x double, y double, mx double, my double")).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 9] and [(r["px"], r["py"]) for r in got if r["id"] == 9] == [(1.0, 1.0)]
