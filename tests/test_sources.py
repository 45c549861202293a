import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from plotline.sources import openaddr, tiles
from plotline.streaming import applied


def feature(geometry, **properties):
    return json.dumps({"type": "Feature", "properties": properties, "geometry": geometry})


POINT = {"type": "Point", "coordinates": [1.5, 2.5]}


def test_lines_and_collections(spark, tmp_path):
    lines = [feature(POINT, number="10 ", street="N OAK AVE", city="GLENDALE", unit=" "), "{broken", feature(None, number="1"), feature({"type": "Point", "coordinates": []}, number="2")]
    (tmp_path / "a.geojson").write_text("\n".join(lines))
    rows = openaddr.read_features(spark, str(tmp_path / "a.geojson"))
    assert openaddr.layer_of(rows) == openaddr.ADDRESSES
    found = openaddr.conform(rows, openaddr.ADDRESSES, expand=True).collect()
    assert [r["tags"] for r in found] == [{"addr:housenumber": "10", "addr:street": "North Oak Avenue", "addr:city": "Glendale"}]
    assert tuple(openaddr.skipped(rows).first()) == (4, 3)
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    whole = {"type": "FeatureCollection", "features": [json.loads(feature({"type": "Polygon", "coordinates": [ring]}, pid="7")), json.loads(feature({"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, pid="8"))]}
    (tmp_path / "b.geojson").write_text(json.dumps(whole))
    rows = openaddr.read_features(spark, str(tmp_path / "b.geojson"))
    assert openaddr.layer_of(rows) == openaddr.PARCELS
    polygons = openaddr.conform(rows, openaddr.PARCELS).select("tags", openaddr.rings_of(F.col("kind"), F.col("coordinates")).alias("p")).collect()
    assert [(r["tags"]["oa:pid"], len(r["p"])) for r in polygons] == [("7", 1), ("8", 2)]


def test_map_extract(spark, tmp_path):
    nodes = "".join(f'<node id="-{i}" lat="{y}" lon="{x}" visible="true">' + ('<tag k="addr:housenumber" v="5"/>' if i == 1 else "") + "</node>" for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 1), (0, 1)]))
    way = '<way id="9">' + "".join(f'<nd ref="-{i}"/>' for i in (0, 1, 2, 3, 0)) + '<tag k="building" v="yes"/></way><way id="10"><nd ref="-1"/><nd ref="-2"/></way>'
    relation = '<relation id="3"><member type="way" ref="9" role="outer"/><tag k="type" v="multipolygon"/></relation>'
    path = tmp_path / "x.osm"
    path.write_text(f'<osm version="0.6">{nodes}{way}{relation}</osm>')
    n, w, r = (f(spark, str(path)) for f in (openaddr.read_nodes, openaddr.read_ways, openaddr.read_relations))
    assert n.where("tags['addr:housenumber'] = '5'").count() == 1 and n.count() == 4
    rings = openaddr.way_rings(n, w).collect()
    assert [(x["id"], len(x["ring"]), x["tags"]) for x in rings] == [(9, 5, {"building": "yes"})]
    assert r.first()["members"][0]["ref"] == 9


# a small writer of tiles and archives
def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def block(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def tile(points, extent=4096):
    zig = lambda n: n * 2 if n >= 0 else -n * 2 - 1
    keys, values, features = [b"number"], [], b""
    for x, y, number in points:
        values.append(block(1, number.encode()))
        geometry = varint(9) + varint(zig(x)) + varint(zig(y))
        features += block(2, block(2, varint(0) + varint(len(values) - 1)) + varint(3 << 3) + varint(1) + block(4, geometry))
    body = block(1, b"addresses") + features + b"".join(block(3, k) for k in keys) + b"".join(block(4, v) for v in values) + varint(5 << 3) + varint(extent)
    return block(3, body)


def archive(entries):
    data, rows = b"", []
    for number, content in entries:
        packed = gzip.compress(content)
        rows.append((number, len(data), len(packed)))
        data += packed
    ids = [n for n, _, _ in rows]
    deltas = [b - a for a, b in zip([0, *ids], ids)]
    plain = varint(len(rows)) + b"".join(map(varint, deltas)) + varint(1) * len(rows) + b"".join(varint(n) for _, _, n in rows) + b"".join(varint(at + 1) for _, at, _ in rows)
    root = gzip.compress(plain)
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(root), 0, 0, 0, 0, 127 + len(root), len(data))
    head += b"\0" * (97 - len(head)) + bytes([2, 2, 1, 1, 1])
    return head + b"\0" * (127 - len(head)) + root + data


def test_archive_points_and_seams(spark, tmp_path):
    left = tile([(100, 100, "1"), (4096, 50, "2"), (5000, 50, "9"), (4096, 70, "3")])
    right = tile([(0, 50, "2"), (4000, 4000, "4")])
    # tile numbers 1 and 4 of zoom 1 are (0, 0) and (1, 0)
    (tmp_path / "a.pmtiles").write_bytes(archive([(1, left), (4, right)]))
    rows = tiles.read_archive(spark, str(tmp_path / "a.pmtiles"))
    assert sorted((r["zoom"], r["tx"], r["ty"]) for r in rows.collect()) == [(1, 0, 0), (1, 1, 0)]
    points = tiles.decode_points(rows)
    assert sorted(r["props"]["number"] for r in points.collect()) == ["1", "2", "2", "3", "4"]
    kept = tiles.without_seams(points).collect()
    assert sorted(r["props"]["number"] for r in kept) == ["1", "2", "3", "4"]
    assert [round(r["lon"], 6) for r in kept if r["props"]["number"] == "2"] == [0.0]


def test_broken_archives():
    with pytest.raises(ValueError):
        tiles.header(b"PMTiles\x02" + b"\0" * 200)
    with pytest.raises(ValueError):
        tiles.varint(b"\xff\xff", 0)
    entries = [(1, 0, 5, 1), (5, 5, 5, 3), (20, 0, 9, 0)]
    assert [tiles.find(entries, t) for t in (0, 1, 3, 7, 8, 50)] == [None, entries[0], None, entries[1], None, entries[2]]


def test_streamed_log_agrees_with_the_batch(spark, tmp_path):
    from plotline.operators.edits import applied_states

    rng = __import__("random").Random(2)
    log = [(i % 7, i, rng.choice([1, 1, -1])) for i in range(200)]
    df = spark.createDataFrame(log, "proposal long, seq long, delta int")
    for part in range(2):
        df.where(f"seq >= {part * 100} AND seq < {part * 100 + 100}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    query = applied.applied_stream(stream).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("states").collect())
    assert got == sorted(tuple(r) for r in applied_states(df).collect())
