"""Which nodes, ways and relations of a map take part in what, by their tags and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators.settings import DIVIDING_ROADS, POI_KEYS, ROADS, plain_address_node

# Fixed values.
RAIL_NOT_DIVIDING = ("abandoned", "razed", "platform")
LEAST_AREA = 1.0
PARCEL_ID = "oa:pid"


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def is_building(tags: Column) -> Column:
    return F.coalesce(tag(tags, "building") != "no", F.lit(False))


def is_road(tags: Column) -> Column:
    return F.coalesce(tag(tags, "highway").isin(*ROADS), F.lit(False))


def divides(tags: Column) -> Column:
    """Whether a way divides what lies on its sides: a road, or a railway in use."""
    road = F.coalesce(tag(tags, "highway").isin(*DIVIDING_ROADS), F.lit(False))
    rail = F.coalesce(~tag(tags, "railway").isin(*RAIL_NOT_DIVIDING), F.lit(False)) & tag(tags, "building").isNull()
    return road | rail


def free_of_features(tags: Column) -> Column:
    """Whether a node is no shop, office, entrance or the like."""
    return ~F.exists(F.map_keys(tags), lambda k: k.isin(*POI_KEYS))


def vertices(ways: DataFrame) -> DataFrame:
    """The nodes that any way (way_id, nodes) passes, each once (node_id)."""
    return ways.select(F.explode("nodes").alias("node_id")).distinct()


def source_nodes(nodes: DataFrame, ways: DataFrame, same_layer: bool = False) -> DataFrame:
    """Nodes (node_id, x, y, tags) with a place and a house number; if they lie in the layer
    that is edited, only plain address nodes that no way passes."""
    rows = nodes.where(F.col("x").isNotNull() & F.col("y").isNotNull() & tag(F.col("tags"), "addr:housenumber").isNotNull())
    if same_layer:
        rows = rows.where(plain_address_node(F.col("tags"))).join(vertices(ways), "node_id", "left_anti")
    return rows


def building_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes that stand for buildings: tagged as such, without a house number, on no way."""
    rows = nodes.where(is_building(F.col("tags")) & tag(F.col("tags"), "addr:housenumber").isNull())
    return rows.join(vertices(ways), "node_id", "left_anti")


def footprints(shapes: DataFrame, area: Column) -> DataFrame:
    """Shapes (with tags) that are buildings of at least a square metre."""
    return shapes.where(is_building(F.col("tags")) & (area >= LEAST_AREA))


def parcels(closed: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """Parcels (cell_id, rings): closed ways (way_id, rings, tags) that are no members of a
    multipolygon that has a shape, and multipolygons (rel_id, rings, tags). Their ids are
    those of the source, or else made from the kind and number of the element."""
    used = members.join(relations.select("rel_id"), "rel_id", "left_semi").select("way_id").distinct()
    named = lambda kind, number: F.coalesce(tag(F.col("tags"), PARCEL_ID), F.concat(F.lit(kind), F.col(number).cast("string"))).alias("cell_id")
    own = closed.join(used, "way_id", "left_anti").select(named("w", "way_id"), "rings")
    return own.unionByName(relations.select(named("r", "rel_id"), "rings"))


def holds_parcels(tags: Column) -> Column:
    """Aggregate: whether any element has the id of a parcel."""
    return F.coalesce(F.bool_or(tag(tags, PARCEL_ID).isNotNull()), F.lit(False))


def mean_place(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The mean of a way's distinct nodes (way_id, x, y): the closing node counts once."""
    each = ways.select("way_id", F.explode(F.array_distinct("nodes")).alias("node_id")).join(nodes.select("node_id", "x", "y"), "node_id")
    return each.groupBy("way_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def shared_vertices(points: DataFrame, lon: str = "lon", lat: str = "lat", digits: int = 7) -> DataFrame:
    """Polygon vertices (owner, i, lon, lat) with the number of the vertex they share: those
    equal to so many digits are one, named by the least (owner, i)."""
    key = [F.round(lon, digits).alias("_x"), F.round(lat, digits).alias("_y")]
    named = points.groupBy(*key).agg(F.min(F.struct("owner", "i")).alias("vertex"))
    return points.withColumns({"_x": F.round(lon, digits), "_y": F.round(lat, digits)}).join(named, ["_x", "_y"]).drop("_x", "_y")


def leaves_bounds(prefix: str, bounds: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``leaves``: whether the box with ``prefix`` is not wholly inside any of the
    downloaded boxes (dxmin, dymin, dxmax, dymax), a list of a few."""
    a = [F.col(prefix + c) for c in ("xmin", "ymin", "xmax", "ymax")]
    every = bounds.agg(F.collect_list(F.struct("dxmin", "dymin", "dxmax", "dymax")).alias("_bounds"))  # one row
    inside = F.exists("_bounds", lambda d: (d["dxmin"] <= a[0]) & (d["dymin"] <= a[1]) & (d["dxmax"] >= a[2]) & (d["dymax"] >= a[3]))
    return rows.crossJoin(F.broadcast(every)).withColumn("leaves", (F.size("_bounds") > 0) & ~inside).drop("_bounds")
