"""Readers on files that the query writes first: what was written must come back."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.plans.town import table
from plotline.session import shared_folder, ship
from plotline.sources import openaddr as O
from plotline.sources import tiles as T
from plotline.spread import dealt, stored


#: Rows of a table in a document, about 43 MB.
DOCUMENT_ROWS = 100_000


def _file(rows: DataFrame) -> str:
    """The folder of a text file written from rows of one text column."""
    path = f"{shared_folder(rows.sparkSession)}/plotline/text-{uuid4().hex}"
    rows.write.text(path)
    return path


def feature_file(spark, sf_dir) -> DataFrame:
    """Address features, one a line, some without a place and some that are no JSON."""
    k = F.col("c_custkey")
    place = F.when(k % 9 == 0, "null").otherwise(F.concat(F.lit('{"type": "Point", "coordinates": ['), (k / 4).cast("string"), F.lit(", "), (k % 50).cast("string"), F.lit("]}")))
    line = F.concat(F.lit('{"type": "Feature", "properties": {"number": " '), k.cast("string"), F.lit('", "street": "'), F.when(k % 2 == 0, "N OAK AVE").otherwise(" "), F.lit('", "city": "GLENDALE"}, "geometry": '), place, F.lit("}"))
    path = _file(table(spark, sf_dir, "customer").select(F.when(k % 13 == 0, F.concat(F.lit("{ broken "), k.cast("string"), F.lit("}"))).otherwise(line).alias("value")))
    rows = O.read_features(spark, path)
    found = O.conform(rows, O.ADDRESSES, expand=True)
    tag = lambda key: F.try_element_at("tags", F.lit(key))
    point = O.point_of(F.col("kind"), F.col("coordinates"))
    return found.select(tag("addr:housenumber").alias("number"), tag("addr:street").alias("street"), tag("addr:city").alias("city"), point["x"].alias("lon"), point["y"].alias("lat"))


def feature_counts(spark, sf_dir) -> DataFrame:
    """Which layer a file of parcels is, and how many of its features are skipped."""
    k = F.col("c_custkey")
    ring = F.concat(F.lit('{"type": "Polygon", "coordinates": [[[0,0],['), (k % 9 + 1).cast("string"), F.lit(",0],[0,2],[0,0]]]}"))
    line = F.concat(F.lit('{"type": "Feature", "properties": {"pid": "'), k.cast("string"), F.lit('"}, "geometry": '), F.when(k % 4 == 0, "null").otherwise(ring), F.lit("}"))
    rows = O.read_features(spark, _file(table(spark, sf_dir, "customer").select(line.alias("value"))))
    return O.skipped(rows).select(F.lit(O.layer_of(rows)).alias("layer"), "features", "skipped")


def map_extract(spark, sf_dir) -> DataFrame:
    """Squares of a map extract in XML: their areas, and the house numbers of their nodes."""
    k = F.col("c_custkey")
    side = k % 5 + 1
    node = lambda i, x, y: F.concat(F.lit('<node id="'), (k * 10 + i).cast("string"), F.lit('" lat="'), y.cast("string"), F.lit('" lon="'), x.cast("string"), F.lit('">'), F.lit('<tag k="addr:housenumber" v="7"/>' if i == 1 else '<tag k="x" v="y"/>'), F.lit("</node>"))
    nodes = [node(i, k + dx * side, F.lit(0) + dy * side) for i, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    refs = F.concat(*[F.concat(F.lit('<nd ref="'), (k * 10 + i).cast("string"), F.lit('"/>')) for i in (0, 1, 2, 3, 0)])
    way = F.concat(F.lit('<way id="'), k.cast("string"), F.lit('">'), refs, F.lit('<tag k="building" v="yes"/></way>'))

    def document(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each partition is a document of its own."""
        yield pd.DataFrame({"value": ['<osm version="0.6">']})
        yield from batches
        yield pd.DataFrame({"value": ["</osm>"]})

    # Spark's reader takes a document whole, and splits of a table's file say little of where its rows are
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    rows = dealt(rows, "c_custkey", least=-(-rows.count() // DOCUMENT_ROWS))
    path = _file(rows.select(F.explode(F.array(*nodes, way)).alias("value")).mapInPandas(document, "value string"))
    read, ways = O.read_nodes(spark, path), O.read_ways(spark, path)
    rings = O.way_rings(read, ways)
    numbered = read.where("tags['addr:housenumber'] IS NOT NULL").groupBy(F.floor(F.col("id") / 10).alias("w")).agg(F.count(F.lit(1)).alias("numbers"))
    size = (F.col("ring")[1]["x"] - F.col("ring")[0]["x"]).cast("double")
    return rings.join(numbered, F.col("id") == F.col("w")).select("id", F.round(size * size, 6).alias("area"), F.try_element_at("tags", F.lit("building")).alias("building"), "numbers")


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _block(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _tile(ids: list[int], places: list[tuple[int, int]]) -> bytes:
    """A vector tile with one layer of points, each with its id as a property."""
    features = []
    for i, (x, y) in enumerate(places):
        commands = _varint(9) + _varint((x << 1) ^ (x >> 31)) + _varint((y << 1) ^ (y >> 31))
        features.append(_block(2, _block(2, _varint(0) + _varint(i)) + _varint(3 << 3) + _varint(1) + _block(4, commands)))
    values = b"".join(_block(4, _block(1, str(i).encode())) for i in ids)
    layer = _block(1, b"a") + b"".join(features) + _block(3, b"id") + values + _varint(5 << 3) + _varint(4096) + _varint(15 << 3) + _varint(2)
    return _block(3, layer)


def vector_tiles(spark, sf_dir) -> DataFrame:
    """Points written into vector tiles of zoom 8, read again, one of each pair on a seam."""
    ship(spark)
    k = F.col("c_custkey")
    # some points lie on the border of two tiles, and both hold them
    px, py = (k * 37) % (16 * 4096), (k * 53) % (16 * 4096)
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 6 == 0, px - px % 4096).otherwise(px).alias("px"), F.when(py % 4096 == 0, py + 1).otherwise(py).alias("py"))
    own = rows.select("id", F.floor(F.col("px") / 4096).alias("tx"), F.floor(F.col("py") / 4096).alias("ty"), (F.col("px") % 4096).alias("x"), (F.col("py") % 4096).alias("y"))
    twice = own.where("x = 0 AND tx > 0").select("id", (F.col("tx") - 1).alias("tx"), "ty", F.lit(4096).cast("long").alias("x"), "y")
    # a tile's points, in three columns: structs become a dict each in Python; few tiles a task, however many bytes Spark would put together
    packed = dealt(own.unionByName(twice).groupBy("tx", "ty").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("p")), "tx", "ty")
    packed = packed.select("tx", "ty", *[F.col(f"p.{c}").alias(c) for c in ("id", "x", "y")])

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                data = _tile(t.id.tolist(), list(zip(t.x.tolist(), t.y.tolist())))
                yield pd.DataFrame({"zoom": [8], "tx": [t.tx], "ty": [t.ty], "tile": [data]})

    tiles = packed.mapInPandas(pack, "zoom int, tx long, ty long, tile binary")
    found = T.without_seams(stored(T.decode_points(tiles), "points"))
    return found.select(F.try_element_at("props", F.lit("id")).cast("long").alias("id"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


QUERIES = {f.__name__: f for f in (feature_file, feature_counts, map_extract, vector_tiles)}

SQL = {
    "feature_file": """SELECT CAST(c_custkey AS VARCHAR) AS number, CASE WHEN c_custkey % 2 = 0 THEN 'North Oak Avenue' END AS street, 'Glendale' AS city, c_custkey / 4 AS lon, CAST(c_custkey % 50 AS DOUBLE) AS lat
FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 13 <> 0""",
    "feature_counts": "SELECT 'PARCELS' AS layer, count(*) AS features, count(*) FILTER (c_custkey % 4 = 0) AS skipped FROM customer",
    "map_extract": "SELECT c_custkey AS id, CAST((c_custkey % 5 + 1) ** 2 AS DOUBLE) AS area, 'yes' AS building, 1::BIGINT AS numbers FROM customer",
    "vector_tiles": f"""WITH r AS (SELECT c_custkey AS id, c_custkey * 37 % 65536 AS px, c_custkey * 53 % 65536 AS py FROM customer),
q AS (SELECT id, CASE WHEN id % 6 = 0 THEN px - px % 4096 ELSE px END AS px, CASE WHEN py % 4096 = 0 THEN py + 1 ELSE py END AS py FROM r)
SELECT id, round(px / 4096 / 256 * 360 - 180, 6) AS lon, round(degrees(atan(sinh({math.pi} * (1 - 2 * (py / 4096 / 256))))), 6) AS lat FROM q""",
}
