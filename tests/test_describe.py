from pyspark.sql import functions as F

from plotline.operators import describe as D
from plotline.sources import custom as S


def test_labels(spark):
    rows = [
        ("CLEAN", None, "building", "house", 120.4, 1, 0.954, "12 #B Oak St → building=house (120 m²)  95%"),
        ("CLEAN", "n5", None, None, None, 1, 0.95, "12 #B Oak St → already on n5  95%"),
        ("FILL_EXISTING", "w5", "building", "house", 9.0, 1, 0.85, "12 #B Oak St → fills w5  85%"),
        ("CLEAN", None, "node", "shed", 9.0, 1, 0.85, "12 #B Oak St → building node shed  85%"),
        ("REVIEW", None, "hint", None, 10.5, 1, 0.6, "12 #B Oak St → hint ? (11 m²)  60%"),
        ("AMBIGUOUS_BUILDING", None, None, None, None, 3, 0.3, "12 #B Oak St → pick one of 3 buildings  30%"),
        ("NO_BUILDING", None, None, None, None, 0, 0.9, "12 #B Oak St  90%"),
    ]
    frame = spark.createDataFrame(rows, "bucket string, found string, layer string, kind string, area double, candidates long, confidence double, expected string")
    said = D.described(F.lit("12"), F.lit("Oak St"), F.lit("B"))
    got = frame.select(D.row_label(said, *[F.col(c) for c in frame.columns[:7]]).alias("label"), "expected").collect()
    assert [r["label"] for r in got] == [r["expected"] for r in got]
    one = spark.range(1).select(D.described(F.lit(None), F.lit(None), F.lit(None)), D.described_all(F.lit(3), F.lit("1 Oak")), D.described_all(F.lit(1), F.lit("1 Oak"))).first()
    assert tuple(one) == ("?", "3 addresses: 1 Oak ...", "1 Oak")


def test_stored_sources_come_back(spark):
    schema = "id long, name string, protocol string, url string, kind string, fields map<string,string>, west double, south double, east double, north double"
    rows = [(1, " A ", "ARCGIS", " u ", "ADDRESSES", {"number": "N", "street": "S + T", "unit": " ", "pid": "P"}, 1.0, 2.0, 3.0, 4.0), (2, "B", "PMTILES", "v", "BUILDINGS", {"number": "N"}, None, None, None, None)]
    entries = S.stored(spark.createDataFrame(rows, schema))
    assert {r["id"]: r["entry"] for r in entries.collect()} == {
        1: {"name": "A", "protocol": "ARCGIS", "url": "u", "kind": "ADDRESSES", "field.number": "N", "field.street": "S,T", "extent": "2.0,1.0,4.0,3.0"},
        2: {"name": "B", "protocol": "PMTILES", "url": "v", "kind": "BUILDINGS"},
    }
    back = {r["id"]: r for r in S.loaded(entries).collect()}
    assert back[1]["fields"] == {"number": "N", "street": "S,T"} and back[1]["west"] == 1.0 and back[2]["fields"] == {} and back[2]["west"] is None
    broken = [(3, {"name": "x"}), (4, {"name": "x", "url": "u", "protocol": "ftp", "kind": "PARCELS"}), (5, {"name": "x", "url": "u", "protocol": "ARCGIS", "kind": "PARCELS", "extent": "a,b"})]
    assert S.loaded(spark.createDataFrame(broken, "id long, entry map<string,string>")).count() == 0
