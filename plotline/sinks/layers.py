"""Layers after edits, and their files.

A layer is a table of elements (pkey, tags, x, y), keyed by a letter for the kind and an
id; x and y are null for what is no point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.geometry import unproject

DIGITS = 7
SOURCE, TARGET = "source", "target"


def edited(elements: DataFrame, commands: DataFrame, layer: str = TARGET) -> DataFrame:
    """``elements`` after the ``commands`` (see operators.apply) for this ``layer``.

    Tags that several commands set on one element are all set, of one key the greatest
    value by proposal; of several moves of a node the last proposal's counts. Commands for
    elements that are not there change nothing, but for added nodes.
    """
    own = commands.where(F.col("layer") == layer)
    new = F.col("op") == "add_node"
    each = own.where("op = 'set_tags'").select("pkey", "proposal", F.explode("tags").alias("_k", "_v"))
    each = each.groupBy("pkey", "_k").agg(F.max_by("_v", F.struct("proposal", "_v")).alias("_v"))
    sets = each.groupBy(F.col("pkey").alias("_p")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("_set"))  # an element's tags
    moves = own.where("op = 'move_node'").groupBy(F.col("pkey").alias("_m")).agg(F.max_by(F.struct("x", "y"), "proposal").alias("_at"))
    gone = own.where("op = 'delete_node'").select(F.col("pkey").alias("_d")).distinct()
    rows = elements.join(gone, F.col("pkey") == F.col("_d"), "left_anti").join(sets, F.col("pkey") == F.col("_p"), "left").join(moves, F.col("pkey") == F.col("_m"), "left")
    kept = F.map_filter("tags", lambda k, v: ~F.coalesce(F.map_contains_key("_set", k), F.lit(False)))
    tags = F.when(F.col("_set").isNull(), F.col("tags")).otherwise(F.map_concat(kept, "_set"))
    out = rows.select("pkey", tags.alias("tags"), F.coalesce("_at.x", "x").alias("x"), F.coalesce("_at.y", "y").alias("y"))
    return out.unionByName(own.where(new).select("pkey", "tags", "x", "y"))


def _tag_list(tags: Column) -> Column:
    """Tags in the order of their keys, as the attributes of XML elements."""
    pairs = F.array_sort(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))))
    return F.transform(pairs, lambda e: F.struct(e["key"].alias("_k"), e["value"].alias("_v")))


def with_degrees(elements: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """lon and lat of points in metres round an origin."""
    lon, lat = unproject(F.col("x"), F.col("y"), F.lit(lon0), F.lit(lat0))
    return elements.withColumns({"lon": F.round(lon, DIGITS), "lat": F.round(lat, DIGITS)})


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Nodes (id, lat, lon, tags) as an extract in XML, a file for each task."""
    shown = nodes.select(F.col("id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.lit(True).alias("_visible"), _tag_list(F.col("tags")).alias("tag"))
    _write(shown, "node", path)


def write_ways(ways: DataFrame, path: str) -> None:
    """Ways (id, nds, tags) as an extract in XML."""
    refs = F.transform("nds", lambda n: F.struct(n.alias("_ref")))
    _write(ways.select(F.col("id").alias("_id"), refs.alias("nd"), _tag_list(F.col("tags")).alias("tag")), "way", path)


def write_relations(relations: DataFrame, path: str) -> None:
    """Relations (id, members, tags) as an extract in XML."""
    members = F.transform("members", lambda m: F.struct(m["type"].alias("_type"), m["ref"].alias("_ref"), m["role"].alias("_role")))
    _write(relations.select(F.col("id").alias("_id"), members.alias("member"), _tag_list(F.col("tags")).alias("tag")), "relation", path)


def _write(rows: DataFrame, tag: str, path: str) -> None:
    rows.write.format("xml").option("rootTag", 'osm version="0.6"').option("rowTag", tag).option("declaration", 'version="1.0" encoding="UTF-8"').save(path)


def write_features(features: DataFrame, path: str) -> None:
    """Features (kind, coordinates, properties), the latter two as JSON, one a line."""
    quoted = F.concat(F.lit('"'), F.col("kind"), F.lit('"'))
    line = F.concat(F.lit('{"type":"Feature","properties":'), F.coalesce("properties", F.lit("{}")), F.lit(',"geometry":{"type":'), quoted, F.lit(',"coordinates":'), F.col("coordinates"), F.lit("}}"))
    features.select(line.alias("value")).write.text(path)
