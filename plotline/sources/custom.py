"""Sources that users describe: what is wrong with a description, and how it is stored.

A description has name, protocol, url, kind, fields (a map from what is wanted to the
service's fields, joined by commas), and an extent west, south, east, north.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.sources.catalog import parsed_fields, valid_bounds

# What each kind of source gives, and what addresses can't do without.
KEYS = {"ADDRESSES": ("number", "street", "unit", "city", "region", "postcode"), "PARCELS": ("pid",), "BUILDINGS": ()}
REQUIRED = ("number", "street")
LABELS = {"number": "housenumber", "street": "street", "unit": "unit", "city": "city", "region": "state", "postcode": "postcode", "pid": "parcel id"}
PROTOCOLS = ("ARCGIS", "OGC_FEATURES", "PMTILES")
EXTENT = ("west", "south", "east", "north")


def own_fields(kind: Column, fields: Column) -> Column:
    """The fields that a source of this kind has use for, blanks left out."""
    out = F.create_map().cast("map<string,string>")
    for name, keys in KEYS.items():
        wanted = F.map_filter(fields, lambda k, v: F.array_contains(F.array(*[F.lit(x) for x in keys]).cast("array<string>"), k) & (F.size(parsed_fields(v)) > 0))
        out = F.when(kind == name, wanted).otherwise(out)
    return out


def problem(
    name: Column, protocol: Column, url: Column, kind: Column, fields: Column, geometry: Column, service_fields: Column, checked_url: Column, checked_protocol: Column, taken: Column
) -> Column:
    """The first thing that is wrong with a description, null if it can be used.

    ``checked_url`` and ``checked_protocol`` are those the service was last asked by, which
    said that it has this ``geometry`` (POINTS, POLYGONS or OTHER) and ``service_fields``;
    ``taken`` is whether another source has the name.
    """
    said = F.lower(F.concat_ws(",", service_fields))
    chosen = lambda key: parsed_fields(F.coalesce(F.try_element_at(fields, F.lit(key)), F.lit("")))
    out = (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "the layer's address is missing")
        .when(~F.coalesce((F.trim(url) == checked_url) & (protocol == checked_protocol), F.lit(False)), "the layer has not been checked")
        .when(F.coalesce(F.trim(name), F.lit("")) == "", "the name is missing")
        .when(taken, F.concat(F.lit("another source is called "), F.trim(name)))
        .when((protocol == "PMTILES") & (kind != "ADDRESSES"), "tile archives hold addresses only")
        .when((geometry == "POINTS") & (kind != "ADDRESSES"), "points can be addresses only")
        .when(geometry == "OTHER", "the layer holds neither points nor polygons")
    )
    known = F.split(said, ",")
    for source_kind, keys in KEYS.items():
        for key in keys:
            unknown = F.filter(chosen(key), lambda f: ~F.array_contains(known, F.lower(f)))
            if source_kind == "ADDRESSES" and key in REQUIRED:
                out = out.when((kind == source_kind) & (F.size(chosen(key)) == 0), f"no field holds the {LABELS[key]}")
            out = out.when((kind == source_kind) & (F.size(service_fields) > 0) & (F.size(unknown) > 0), F.concat(F.lit("the layer has no field "), F.try_element_at(unknown, F.lit(1))))
    return out


def names_taken(sources: DataFrame) -> DataFrame:
    """``sources`` (id, name) with ``taken``: whether another one has the name, in any case."""
    return sources.withColumn("taken", F.count(F.lit(1)).over(Window.partitionBy(F.lower(F.trim("name")))) > 1)


def stored(sources: DataFrame) -> DataFrame:
    """Rows (id, entry): each source as a flat map; what its kind has no use for is left out."""
    parts = F.create_map(F.lit("name"), F.trim("name"), F.lit("protocol"), F.col("protocol"), F.lit("url"), F.trim("url"), F.lit("kind"), F.col("kind"))
    kept = own_fields(F.col("kind"), F.col("fields"))
    flat = F.transform_keys(F.transform_values(kept, lambda k, v: F.array_join(parsed_fields(v), ",")), lambda k, v: F.concat(F.lit("field."), k))
    extent = F.create_map(F.lit("extent"), F.concat_ws(",", *[F.col(c).cast("string") for c in ("south", "west", "north", "east")]))
    has = valid_bounds(*[F.col(c) for c in EXTENT])
    return sources.select("id", F.map_concat(parts, flat, F.when(has, extent).otherwise(F.create_map().cast("map<string,string>"))).alias("entry"))


def loaded(entries: DataFrame) -> DataFrame:
    """Sources of stored entries (id, entry); entries that can't be read are left out."""
    value = lambda k: F.try_element_at("entry", F.lit(k))
    fields = F.transform_keys(F.map_filter("entry", lambda k, v: F.startswith(k, F.lit("field."))), lambda k, v: F.substring(k, 7, 100))
    side = {c: F.try_element_at(F.split(value("extent"), ","), F.lit(i + 1)).try_cast("double") for i, c in enumerate(("south", "west", "north", "east"))}
    readable = value("name").isNotNull() & value("url").isNotNull() & value("protocol").isin(*PROTOCOLS) & value("kind").isin(*KEYS)
    rows = entries.where(F.coalesce(readable, F.lit(False))).select(
        "id", F.trim(value("name")).alias("name"), value("protocol").alias("protocol"), F.trim(value("url")).alias("url"), value("kind").alias("kind"),
        own_fields(value("kind"), fields).alias("fields"), *[side[c].alias(c) for c in EXTENT], value("extent").alias("_extent"),
    )
    return rows.where(F.col("_extent").isNull() | valid_bounds(*[F.col(c) for c in EXTENT])).drop("_extent")
