"""Source definitions and catalogs of datasets as tables, and the answers of services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LAYER_KINDS = {"addresses": "ADDRESSES", "parcels": "PARCELS", "buildings": "BUILDINGS"}
COVERAGE_PARTS = ("county", "city", "town", "state", "country")
UNNAMED = "OpenAddresses"
LOCAL_LEVELS, STATE_LEVEL = ("city", "town"), "state"
SOURCE_FILE = "https://raw.githubusercontent.com/openaddresses/openaddresses/master/sources/{}.json"


def source_layers(definitions: DataFrame, json_col: str = "json") -> DataFrame:
    """Usable layers of source definitions, a row each: the definition's other columns, kind,
    name, url, condition, licence and the fields of each tag (conform).

    Only definitions of schema 2 count, only their layers of a feature service, and of
    address layers only those that say where the number is. A tag's fields are one name
    or a list of names; rules given as functions are left out.
    """
    rest = [c for c in definitions.columns if c != json_col]
    text = F.col(json_col)
    at = lambda path: F.get_json_object(text, path)
    rows = definitions.where(F.coalesce(at("$.schema").cast("int"), F.lit(1)) == 2)
    rows = rows.withColumn("_base", _coverage_name(text))
    layers = F.map_filter(F.from_json(at("$.layers"), "map<string,array<string>>"), lambda k, v: k.isin(*LAYER_KINDS))
    rows = rows.withColumn("_root_licence", at("$.license")).select(*rest, "_base", "_root_licence", F.explode(layers).alias("_layer", "_entries"))
    rows = rows.select(*rest, "_base", "_root_licence", "_layer", F.posexplode("_entries").alias("_i", "_e"))
    of = lambda path: F.get_json_object("_e", path)
    rows = rows.where(of("$.protocol") == "ESRI").withColumn("conform", _fields(of("$.conform")))
    kind = F.create_map(*[F.lit(x) for pair in LAYER_KINDS.items() for x in pair])[F.col("_layer")]
    rows = rows.withColumn("kind", kind).where((F.col("kind") != "ADDRESSES") | F.map_contains_key("conform", "number"))
    name = F.concat(F.col("_base"), F.lit(" "), F.col("_layer"), F.coalesce(F.concat(F.lit(" ("), of("$.name"), F.lit(")")), F.lit("")))
    return rows.select(*rest, "kind", name.alias("name"), of("$.data").alias("url"), of("$._where").alias("condition"), F.coalesce(of("$.license"), "_root_licence").alias("licence"), "conform")


def _coverage_name(text: Column) -> Column:
    """County, city, town, state and country of the coverage, those that are texts."""
    parts = [F.get_json_object(text, f"$.coverage.{p}") for p in COVERAGE_PARTS]
    # numbers, lists and the like begin with what no name begins with
    said = F.concat_ws(", ", *[F.when(~p.rlike(r"^(-?[0-9.]+|true|false|[\[{].*)$"), p) for p in parts])
    return F.when(said == "", UNNAMED).otherwise(said)


def _fields(conform: Column) -> Column:
    """Tags and their fields from a conform object, but for ``format`` and functions."""
    given = F.coalesce(F.from_json(conform, "map<string,string>"), F.create_map().cast("map<string,string>"))
    listed = F.map_filter(given, lambda k, v: (k != "format") & ~v.startswith("{"))
    return F.transform_values(listed, lambda k, v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v)))


def requested_fields(conform: Column) -> Column:
    """The fields of all tags, each once, in order; all of them (``*``) where none is named."""
    every = F.array_distinct(F.flatten(F.map_values(conform)))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("*")))


def parsed_fields(said: Column) -> Column:
    """Names from a list typed with ``+`` or ``,``."""
    return F.filter(F.split(F.trim(F.coalesce(said, F.lit(""))), r"\s*[+,]\s*"), lambda f: f != "")


def shown_fields(fields: Column) -> Column:
    return F.array_join(fields, " + ")


def source_address(said: Column) -> Column:
    """Where a source is defined: an address as it is, or the public file of a source's id."""
    trimmed = F.trim(said)
    return F.when(trimmed.rlike("(?i)^https?://"), trimmed).otherwise(F.concat(F.lit(SOURCE_FILE.split("{}")[0]), F.lower(F.regexp_replace(trimmed, r"\.json$", "")), F.lit(SOURCE_FILE.split("{}")[1])))


def parcel_datasets(entries: DataFrame) -> DataFrame:
    """Entries (layer, map, source, name, updated) of a catalog that are parcels with a coverage."""
    return entries.where((F.col("layer") == "parcels") & (F.coalesce("map", F.lit(0)) != 0))


def level_rank(level: Column) -> Column:
    """City before county before state: the more local source is usually the better map."""
    return F.when(level.isin(*LOCAL_LEVELS), 0).when(level == STATE_LEVEL, 2).otherwise(1)


def datasets_for(found: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets for coverages that were found (view, place, map), one per view and source:
    that of the first coverage, and of its first entry (seq). ``place`` in the result is
    the dataset's place in the list that a view shows, the most local first."""
    from pyspark.sql import Window

    # a view's first coverage of a map and a source's first entry of it decide; so neither many
    # coverages nor many entries of a map are paired with each other
    rest = [c for c in datasets.columns if c not in ("map", "source")]
    first = lambda c: F.min(F.struct(c))[c]
    nearest = found.groupBy("view", "map").agg(first("place").alias("_place"))
    entries = datasets.groupBy("map", "source").agg(F.min_by(F.struct(*rest), F.struct("seq")).alias("_d")).select("map", "source", "_d.*")
    joined = nearest.join(entries, "map")
    one = joined.groupBy("view", "source").agg(F.min_by(F.struct("map", *rest), F.struct("_place", "seq")).alias("d")).select("view", "source", "d.*")
    order = Window.partitionBy("view").orderBy(level_rank(F.col("level")), "source")
    return one.withColumn("place", F.row_number().over(order))


def valid_bounds(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether an extent is one: within the world, not turned round, more than a point."""
    known = west.isNotNull() & south.isNotNull() & east.isNotNull() & north.isNotNull()
    within = west.between(-180, 180) & east.between(-180, 180) & south.between(-90, 90) & north.between(-90, 90)
    return F.coalesce(known & within & (west <= east) & (south <= north) & ((west < east) | (south < north)), F.lit(False))


ESRI_FEATURE = "struct<attributes:string,geometry:struct<x:double,y:double,rings:string,paths:array<string>>>"


def esri_features(answers: DataFrame, json_col: str = "json") -> DataFrame:
    """Features (kind, coordinates, properties) of a service's own JSON, a row each: points,
    polygons, and of lines the first path; features without any of these are dropped."""
    rest = [c for c in answers.columns if c != json_col]
    features = F.from_json(F.get_json_object(json_col, "$.features"), f"array<{ESRI_FEATURE}>")
    rows = answers.select(*rest, F.explode(features).alias("f"))
    g = F.col("f.geometry")
    point = g["x"].isNotNull()
    kind = F.when(point, "Point").when(g["rings"].isNotNull(), "Polygon").when(F.size(g["paths"]) > 0, "LineString")
    coordinates = F.when(point, F.to_json(F.array(g["x"], g["y"]))).when(g["rings"].isNotNull(), g["rings"]).otherwise(g["paths"][0])
    return rows.select(*rest, kind.alias("kind"), coordinates.alias("coordinates"), F.coalesce("f.attributes", F.lit("{}")).alias("properties")).where("kind IS NOT NULL")


def wrong_geometry(kind: Column, wanted: Column) -> Column:
    """Aggregate: whether all features are points though parcels or buildings are wanted."""
    return F.coalesce(F.bool_and(kind.isin("Point", "MultiPoint")) & F.first(wanted).isin("PARCELS", "BUILDINGS"), F.lit(False))


def file_of(address: Column) -> Column:
    """An address without the layer behind ``#``."""
    return F.substring_index(address, "#", 1)


def layer_of_address(address: Column) -> Column:
    """The layer named behind ``#``, decoded; null if there is none."""
    behind = F.when(F.contains(address, F.lit("#")), F.substring(address, F.instr(address, "#") + 1, F.length(address)))
    return F.when(behind != "", F.url_decode(behind))
