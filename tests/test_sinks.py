from uuid import uuid4


from plotline.session import shared_folder
from plotline.sinks import layers as L
from plotline.sources import openaddr as O

ELEMENTS = "pkey string, tags map<string,string>, x double, y double"
COMMANDS = "proposal long, step int, layer string, op string, pkey string, tags map<string,string>, x double, y double"


def folder(spark):
    return f"{shared_folder(spark)}/plotline/test-{uuid4().hex}"


def test_edited_layer(spark):
    elements = spark.createDataFrame([("b1", {"building": "yes", "addr:unit": "9"}, None, None), ("n1", {"a": "1"}, 0.0, 0.0), ("n2", {}, 5.0, 5.0), ("n3", None, 7.0, 7.0)], ELEMENTS)
    rows = [
        (1, 1, "target", "set_tags", "b1", {"addr:housenumber": "7", "addr:street": "Oak"}, None, None), (2, 1, "target", "set_tags", "b1", {"addr:street": "Elm"}, None, None),
        (3, 1, "target", "move_node", "n1", {}, 1.0, 2.0), (4, 1, "target", "move_node", "n1", {}, 3.0, 4.0), (5, 1, "target", "add_node", "n9", {"k": "v"}, 8.0, 8.0),
        (6, 2, "target", "delete_node", "n2", {}, None, None), (6, 2, "source", "delete_node", "n3", {}, None, None), (7, 1, "target", "set_tags", "b8", {"x": "y"}, None, None),
    ]
    commands = spark.createDataFrame(rows, COMMANDS)
    got = {r["pkey"]: (r["tags"], r["x"], r["y"]) for r in L.edited(elements, commands).collect()}
    assert got == {
        "b1": ({"building": "yes", "addr:unit": "9", "addr:housenumber": "7", "addr:street": "Elm"}, None, None), "n1": ({"a": "1"}, 3.0, 4.0),
        "n3": (None, 7.0, 7.0), "n9": ({"k": "v"}, 8.0, 8.0),
    }
    assert {r["pkey"] for r in L.edited(elements, commands, L.SOURCE).collect()} == {"b1", "n1", "n2"}


def test_extracts_come_back(spark):
    awkward = {"name": 'A & B <"x">', "note": "two\nlines é"}
    nodes = spark.createDataFrame([(1, 33.5, -112.25, awkward), (-2, 0.0, 0.0, {}), (3, 1.0, 2.0, None)], "id long, lat double, lon double, tags map<string,string>")
    L.write_nodes(nodes, at := folder(spark))
    got = {r["id"]: (r["lat"], r["lon"], r["tags"]) for r in O.read_nodes(spark, at).collect()}
    assert got[1][:2] == (33.5, -112.25) and got[1][2]["name"] == awkward["name"] and got[-2] == (0.0, 0.0, {}) and got[3][2] == {}
    ways = spark.createDataFrame([(5, [1, 2, 3, 1], {"building": "yes"})], "id long, nds array<long>, tags map<string,string>")
    L.write_ways(ways, at := folder(spark))
    assert [tuple(r) for r in O.read_ways(spark, at).collect()] == [(5, [1, 2, 3, 1], {"building": "yes"})]
    members = "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"
    L.write_relations(spark.createDataFrame([(7, [("way", 5, "outer")], {"type": "multipolygon"})], members), at := folder(spark))
    read = O.read_relations(spark, at).first()
    assert [tuple(m) for m in read["members"]] == [("way", 5, "outer")] and read["tags"] == {"type": "multipolygon"}


def test_features_come_back(spark):
    rows = [("Point", "[1.5,2.0]", '{"number":"7","street":"Oak"}'), ("Polygon", "[[[0,0],[1,0],[0,1],[0,0]]]", None)]
    L.write_features(spark.createDataFrame(rows, "kind string, coordinates string, properties string"), at := folder(spark))
    got = {r["geometry"]["type"]: r for r in O.read_features(spark, at).collect()}
    assert got["Point"]["properties"]["number"] == "7" and got["Polygon"]["geometry"]["coordinates"].replace(" ", "") == rows[1][1]
    places = L.with_degrees(spark.createDataFrame([(0.0, 0.0), (None, None)], "x double, y double"), -112.0, 33.0).collect()
    assert (places[0]["lon"], places[0]["lat"], places[1]["lon"]) == (-112.0, 33.0, None)
