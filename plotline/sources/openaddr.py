"""Readers of address, parcel and footprint files, and of map extracts in XML.

Features come as one JSON object per line, or as one collection; map extracts as XML.
Everything is read by Spark's own readers with explicit schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.functions.address import expand_street, title_if_capitals

PROPERTIES = ("id", "number", "street", "unit", "city", "district", "region", "postcode", "pid", "height", "hash")
FEATURE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.StructType([T.StructField(p, T.StringType()) for p in PROPERTIES])),
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    ]
)
NODE = "_id LONG, _lat DOUBLE, _lon DOUBLE, _visible BOOLEAN, tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
WAY = "_id LONG, nd ARRAY<STRUCT<_ref: LONG>>, tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
RELATION = "_id LONG, member ARRAY<STRUCT<_type: STRING, _ref: LONG, _role: STRING>>, tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"

ADDRESSES, PARCELS, BUILDINGS = "ADDRESSES", "PARCELS", "BUILDINGS"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features (properties, geometry, bad): one per line, or the parts of one collection.

    A file whose first line opens a document that doesn't end there, or is a collection,
    is read as a whole. Lines that are no JSON come as rows with ``bad`` set.
    """
    head = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").head()  # one line
    first = head["v"] if head else ""
    if first and (not first.endswith("}") or '"FeatureCollection"' in first):
        schema = T.StructType([T.StructField("features", T.ArrayType(FEATURE))])
        whole = spark.read.schema(schema).option("multiLine", "true").json(path)
        return whole.select(F.explode("features").alias("f")).select("f.properties", "f.geometry", F.lit(None).cast("string").alias("bad"))
    schema = T.StructType([*FEATURE.fields, T.StructField("bad", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    return rows.select("properties", "geometry", "bad")


def layer_of(features: DataFrame) -> str:
    """What a file holds, by its first feature's properties."""
    first = features.where("bad IS NULL AND properties IS NOT NULL").select("properties").head()  # one row
    if first is None:
        return BUILDINGS
    has = first["properties"].asDict()
    if has.get("pid") is not None:
        return PARCELS
    return ADDRESSES if has.get("number") is not None or has.get("street") is not None else BUILDINGS


def conform(features: DataFrame, layer: str, expand: bool = False) -> DataFrame:
    """Features with their tags; blanks are dropped, values trimmed. Rows without a usable
    geometry, and bad ones, are counted by ``skipped`` instead."""

    def value(name: str) -> Column:
        return F.trim(F.col(f"properties.{name}"))

    if layer == ADDRESSES:
        street = expand_street(value("street")) if expand else value("street")
        pairs = {
            "addr:housenumber": value("number"), "addr:street": street, "addr:unit": value("unit"), "addr:city": title_if_capitals(value("city")),
            "addr:postcode": value("postcode"), "addr:state": value("region"), "addr:district": value("district"),
        }
    elif layer == PARCELS:
        pairs = {"oa:pid": value("pid"), "oa:layer": F.lit("parcels")}
    else:
        pairs = {"building": F.lit("yes"), "height": value("height")}
    tags = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: F.coalesce(v, F.lit("")) != "")
    return features.where(usable()).select(F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("coordinates"), tags.alias("tags"))


def usable() -> Column:
    geometry = F.coalesce(F.regexp_replace("geometry.coordinates", r"[\[\]\s]", ""), F.lit(""))
    return F.col("bad").isNull() & (geometry != "")


def skipped(features: DataFrame) -> DataFrame:
    """One row: features read, and those skipped for want of a geometry or of JSON."""
    return features.agg(F.count(F.lit(1)).alias("features"), F.count_if(~usable()).alias("skipped"))


def rings_of(kind: Column, coordinates: Column) -> Column:
    """Polygons of a feature, each an array of rings of (x, y); null for other kinds."""
    ring = "array<array<array<double>>>"
    one = F.from_json(coordinates, ring)
    many = F.from_json(coordinates, f"array<{ring}>")
    both = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    return F.transform(both, lambda poly: F.transform(poly, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))


def point_of(kind: Column, coordinates: Column) -> Column:
    """Position of a point feature."""
    p = F.from_json(coordinates, "array<double>")
    return F.when(kind == "Point", F.struct(p[0].alias("x"), p[1].alias("y")))


def _tags(df: DataFrame) -> Column:
    return F.coalesce(F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"]))), F.create_map().cast("map<string,string>"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes (id, lat, lon, tags) of a map extract."""
    df = spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path)
    return df.select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags(df).alias("tags"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """Ways (id, nds, tags) of a map extract, nodes in order."""
    df = spark.read.format("xml").option("rowTag", "way").schema(WAY).load(path)
    return df.select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("nds"), _tags(df).alias("tags"))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relations (id, members, tags) of a map extract."""
    df = spark.read.format("xml").option("rowTag", "relation").schema(RELATION).load(path)
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    return df.select(F.col("_id").alias("id"), members.alias("members"), _tags(df).alias("tags"))


def way_rings(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Closed ways of four nodes or more, complete, as rings of (x, y) = (lon, lat)."""
    closed = ways.where((F.size("nds") >= 4) & (F.element_at("nds", 1) == F.element_at("nds", -1)))
    points = closed.select("id", F.posexplode("nds").alias("pos", "ref")).join(nodes.select(F.col("id").alias("_n"), "lon", "lat"), F.col("ref") == F.col("_n"))
    rings = points.groupBy(F.col("id").alias("_w")).agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    ring = F.transform("p", lambda q: F.struct(q["lon"].alias("x"), q["lat"].alias("y")))
    return closed.join(rings, F.col("id") == F.col("_w")).where(F.size("p") == F.size("nds")).select("id", ring.alias("ring"), "tags")
