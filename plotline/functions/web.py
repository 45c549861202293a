"""Addresses of services and the answers they give, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ARCGIS_LAYER = r"(?i)^.*/(FeatureServer|MapServer)/\d+/*$"
OGC_COLLECTION = r"(?i)^.*/collections/[^/]+/*$"
PMTILES_FILE = r"(?i)^.*\.pmtiles$"
WEB_ADDRESS = r"(?i)(https?://[^\s\"'<>]+)"
ARCGIS_OPERATION = r"(?i)^(.*/(?:FeatureServer|MapServer)/\d+)(?:[/?].*)?$"
OGC_ITEMS = r"(?i)^(.*/collections/[^/?]+)(/items[^?]*)?/*(?:\?(.*))?$"
ITEM_PARAMETERS = ("bbox", "bbox-crs", "crs", "limit", "offset", "startindex", "f", "datetime")
BUILDING_WORDS = "(?i)building|footprint|structure|bldg"
PARCEL_WORDS = "(?i)parcel|cadastr|tax[ _-]?lot"
ADDRESS_WORDS = "(?i)address|situs|e911"
#: Largest area of one request, in square degrees.
AREA_LIMIT = 0.02


def protocol(url: Column) -> Column:
    """ARCGIS, OGC_FEATURES, PMTILES or null, by the path of a service's address."""
    path = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"\?.*$", "")
    return F.when(path.rlike(ARCGIS_LAYER), "ARCGIS").when(path.rlike(OGC_COLLECTION), "OGC_FEATURES").when(path.rlike(PMTILES_FILE), "PMTILES")


def clean_url(pasted: Column) -> Column:
    """The layer's address within pasted text: without operations and item parameters, but with keys."""
    found = F.regexp_extract(pasted, WEB_ADDRESS, 1)
    kept = F.filter(F.split(F.regexp_extract(found, OGC_ITEMS, 3), "&"), lambda p: (p != "") & ~F.lower(F.regexp_replace(p, "=.*$", "")).isin(*ITEM_PARAMETERS))
    base = F.regexp_extract(found, OGC_ITEMS, 1)
    return (
        F.when(F.coalesce(found, F.lit("")) == "", F.coalesce(F.trim(pasted), F.lit("")))
        .when(found.rlike(ARCGIS_OPERATION), F.regexp_extract(found, ARCGIS_OPERATION, 1))
        .when(found.rlike(OGC_ITEMS), F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base))
        .otherwise(found)
    )


def suggested_kind(title: Column, url: Column, geometry: Column) -> Column:
    """What a layer most likely holds: its geometry first, then words in its name."""
    name = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.regexp_replace(F.coalesce(url, F.lit("")), r"\?.*$", ""))
    return (
        F.when(geometry == "POINTS", "ADDRESSES").when(name.rlike(BUILDING_WORDS), "BUILDINGS").when(name.rlike(PARCEL_WORDS), "PARCELS").when(name.rlike(ADDRESS_WORDS), "ADDRESSES").when(geometry == "POLYGONS", "PARCELS")
    )


def squashed(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def guessed_field(fields: Column, wanted: tuple[str, ...]) -> Column:
    """The first of the wanted names, most specific first, that a service's fields have."""
    hits = [F.try_element_at(_named(fields, w), F.lit(1)) for w in wanted]
    return F.coalesce(*hits)


def _named(fields: Column, wanted: str) -> Column:
    key = "".join(c for c in wanted.lower() if c.isalnum())
    return F.filter(fields, lambda f: squashed(f) == key)


def conformed(*fields: Column) -> Column:
    """Non-blank values, trimmed, joined by one space; null if there is none."""
    joined = F.concat_ws(" ", *[F.when(F.trim(f.cast("string")) != "", F.trim(f.cast("string"))) for f in fields])
    return F.when(joined != "", joined)


def area_too_large(west: Column, south: Column, east: Column, north: Column) -> Column:
    return (east - west) * (north - south) > AREA_LIMIT


def boxes_meet(a: tuple, b: tuple) -> Column:
    """Whether two boxes (west, south, east, north) meet; an unknown one meets any."""
    unknown = a[0].isNull() | b[0].isNull()
    return unknown | ((a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3]))


def query_url(layer: Column, box: tuple, fields: tuple[str, ...], where: str | None, offset: int, size: int = 1000) -> Column:
    """A page request to a feature layer: envelope, fields, condition and paging pushed to the server."""
    envelope = F.concat_ws(",", *[c.cast("string") for c in box])
    return F.concat(
        layer, F.lit("/query?where="), F.url_encode(F.lit(where or "1=1")), F.lit("&geometry="), F.url_encode(envelope),
        F.lit("&geometryType=esriGeometryEnvelope&inSR=4326&outSR=4326&outFields="), F.url_encode(F.lit(",".join(fields) or "*")),
        F.lit(f"&resultOffset={offset}&resultRecordCount={size}&f=geojson"),
    )


def service_error(body: Column) -> Column:
    """The plain text of a service's error answer, spaces squeezed, cut to 160 characters; null if it is none."""
    said = F.coalesce(
        F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.error.details[0]"), F.get_json_object(body, "$.error.code"),
        F.when(F.get_json_object(body, "$.status") == "error", F.coalesce(F.get_json_object(body, "$.messages[0]"), F.lit("error"))),
        F.nullif(F.regexp_extract(body, r"(?is)<title>\s*(.*?)\s*</title>", 1), F.lit("")),
    )
    plain = F.trim(F.regexp_replace(said, r"\s+", " "))
    return F.when(F.length(plain) > 160, F.concat(F.substr(plain, F.lit(1), F.lit(160)), F.lit("..."))).otherwise(plain)


def transfer_limited(body: Column) -> Column:
    """Whether a page says that the server held rows back; the properties' flag comes first."""
    return F.coalesce(F.get_json_object(body, "$.properties.exceededTransferLimit"), F.get_json_object(body, "$.exceededTransferLimit"), F.lit("false")) == "true"
