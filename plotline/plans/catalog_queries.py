"""Queries of source definitions, catalogs and service answers, each with its SQL. The
documents are made from the keys of the parts, as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.plans.town import table
from plotline.sources import catalog as C
from plotline.sources import custom as S


def _part(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def _choice(k: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


COVERAGES = ('{"country": "us", "state": "ca", "county": "Kern"}', '{"city": "Reno", "country": "us", "geometry": {"type": "Point"}}', "{}", '{"town": 7, "state": "ny"}')
NUMBERS = ('"HOUSE"', '["PRE", "HOUSE"]', '{"function": "regexp", "field": "A"}')


def _definitions(spark, sf_dir) -> DataFrame:
    k = F.col("id")
    part = lambda text: F.lit(text)
    number = _choice(k, NUMBERS)
    json = F.concat(
        part('{"schema": '), F.when(k % 11 == 0, "1").otherwise("2"), part(', "license": "root", "coverage": '), _choice(k, COVERAGES),
        part(', "layers": {"addresses": [{"protocol": "'), F.when(k % 5 == 0, "http").otherwise("ESRI"), part('", "data": "https://e.com/'), k.cast("string"),
        part('", "conform": {"format": "geojson", "number": '), number, part(', "street": ["ST", "TYPE"]}}], "parcels": [{"protocol": "ESRI", "data": "https://p.com/'), k.cast("string"),
        part('", "name": "lots", "_where": "A=1", "license": {"url": "x"}, "conform": {"pid": "APN"}}], "other": [{"protocol": "ESRI", "data": "x"}]}}'),
    )
    return _part(spark, sf_dir).select("id", json.alias("json"))


def source_layers(spark, sf_dir) -> DataFrame:
    rows = C.source_layers(_definitions(spark, sf_dir))
    return rows.select("id", "kind", "name", "url", "condition", "licence", F.array_join(C.requested_fields(F.col("conform")), ",").alias("fields"))


def catalog_join(spark, sf_dir) -> DataFrame:
    """Datasets for the coverages that each view finds, one per source, most local first."""
    o = table(spark, sf_dir, "orders")
    found = o.select((F.col("o_custkey") % 50).alias("view"), F.col("o_orderkey").alias("place"), (F.col("o_orderkey") % 97).alias("map"))
    k = F.col("id")
    entries = _part(spark, sf_dir).select(
        F.when(k % 6 == 0, "addresses").otherwise("parcels").alias("layer"), F.when(k % 19 == 0, F.lit(None)).otherwise(k % 97).alias("map"),
        F.concat(F.lit("us/"), (k % 31).cast("string")).alias("source"), _choice(k, ("city", "county", "state", "town")).alias("level"), k.alias("seq"),
    )
    return C.datasets_for(found, C.parcel_datasets(entries)).select("view", "source", "map", "level", "seq", F.col("place").cast("long").alias("place"))


def extent_checks(spark, sf_dir) -> DataFrame:
    k = F.col("id")
    w, s = (k % 400 - 200).cast("double"), (k * 7 % 200 - 100).cast("double")
    e, n = w + k % 3 - F.when(k % 17 == 0, 5).otherwise(0), F.when(k % 23 == 0, F.lit(None)).otherwise(s + k % 2)
    return _part(spark, sf_dir).select("id", C.valid_bounds(w, s, e, n).alias("valid"))


FIELDS = ("HOUSE + STREET", "A,B ,C", " one ", "", None, "A++B")


def field_lists(spark, sf_dir) -> DataFrame:
    return _part(spark, sf_dir).select("id", C.shown_fields(C.parsed_fields(_choice(F.col("id"), FIELDS))).alias("fields"))


GEOMETRIES = ('{"x": 1.5, "y": 2.5}', '{"rings": [[[0,0],[4,0],[0,3],[0,0]]]}', '{"paths": [[[0,0],[1,1]],[[5,5],[6,6]]]}', '{"paths": []}', "null")


def esri_features(spark, sf_dir) -> DataFrame:
    k = F.col("id")
    one = lambda i: F.concat(F.lit('{"attributes": {"A": '), i.cast("string"), F.lit('}, "geometry": '), _choice(i, GEOMETRIES), F.lit("}"))
    json = F.concat(F.lit('{"features": ['), one(k), F.lit(","), one(k + 1), F.lit('], "exceededTransferLimit": true}'))
    rows = C.esri_features(_part(spark, sf_dir).select("id", json.alias("json")))
    return rows.select("id", "kind", F.regexp_replace("coordinates", " ", "").alias("coordinates"), F.get_json_object("properties", "$.A").cast("long").alias("a"))


def point_layers(spark, sf_dir) -> DataFrame:
    """Layers of points that are to feed parcels or buildings."""
    k = F.col("id")
    rows = _part(spark, sf_dir).select((k % 100).alias("layer"), F.when((k % 100 % 3 == 0) & (k % 700 == k % 100), "Polygon").otherwise("Point").alias("kind"), _choice(k % 100, ("PARCELS", "ADDRESSES")).alias("wanted"))
    return rows.groupBy("layer").agg(C.wrong_geometry(F.col("kind"), F.col("wanted")).alias("wrong"))


ADDRESSES = ("https://e.com/a.pmtiles#land%20use", "https://e.com/b.pmtiles", "https://e.com/c.pmtiles#", "US/CA/Kern", " http://e.com/x.json ")


def source_addresses(spark, sf_dir) -> DataFrame:
    said = _choice(F.col("id"), ADDRESSES)
    return _part(spark, sf_dir).select("id", C.source_address(said).alias("address"), C.file_of(said).alias("file"), C.layer_of_address(said).alias("layer"))


def _sources(spark, sf_dir) -> DataFrame:
    """Descriptions of sources, one a customer, with whatever can be wrong with them."""
    k = F.col("c_custkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    url = F.concat(F.lit("https://x/"), (k % 7).cast("string"))
    fields = F.create_map(F.lit("number"), F.when(k % 3 == 0, " ").otherwise("NUM"), F.lit("street"), F.when(k % 4 == 0, "ST + Dir").otherwise("st"), F.lit("pid"), F.lit("APN"))
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit(" Source "), F.when(k % 13 == 0, "twin").otherwise(k.cast("string")))).alias("name"),
        pick(("ARCGIS", "OGC_FEATURES", "PMTILES"), k).alias("protocol"), F.when(k % 17 == 0, "").otherwise(url).alias("url"), pick(("ADDRESSES", "PARCELS", "BUILDINGS", "ADDRESSES"), F.floor(k / 3)).alias("kind"),
        fields.alias("fields"), pick(("POINTS", "POLYGONS", "OTHER", "POLYGONS", "POINTS"), F.floor(k / 5)).alias("geometry"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("num"), F.lit("St"), F.lit("apn"))).alias("service_fields"),
        F.when(k % 19 == 0, "https://y").otherwise(url).alias("checked_url"), pick(("ARCGIS", "OGC_FEATURES", "PMTILES"), k).alias("checked_protocol"),
        (-(k % 100)).cast("double").alias("west"), (k % 50).cast("double").alias("south"), F.when(k % 23 == 0, -200.0).otherwise(10.0).alias("east"), F.lit(60.0).alias("north"),
    )


def source_problems(spark, sf_dir) -> DataFrame:
    rows = S.names_taken(_sources(spark, sf_dir))
    columns = ("name", "protocol", "url", "kind", "fields", "geometry", "service_fields", "checked_url", "checked_protocol", "taken")
    return rows.select("id", S.problem(*[F.col(c) for c in columns]).alias("problem"))


def stored_sources(spark, sf_dir) -> DataFrame:
    """Sources that come back from their stored entries, a few of which can't be read."""
    entries = S.stored(_sources(spark, sf_dir))
    broken = F.map_concat(F.map_filter("entry", lambda k, v: k != "kind"), F.create_map(F.lit("kind"), F.lit("LAKES")))
    entries = entries.withColumn("entry", F.when(F.col("id") % 29 == 0, broken).otherwise(F.col("entry")))
    field = lambda k: F.try_element_at("fields", F.lit(k)).alias(k)
    return S.loaded(entries).select("id", "name", "kind", field("number"), field("street"), field("pid"), "west", "north")


QUERIES = {f.__name__: f for f in (source_problems, stored_sources, source_layers, catalog_join, extent_checks, field_lists, esri_features, point_layers, source_addresses)}

_NAMES = ("Kern, ca, us", "Reno, us", "OpenAddresses", "ny")


def _pick(k: str, values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][({k}) % {len(values)} + 1]"


_SOURCES = """WITH b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'Source ' || CASE WHEN c_custkey % 13 = 0 THEN 'twin' ELSE c_custkey::VARCHAR END END AS name,
    ['ARCGIS', 'OGC_FEATURES', 'PMTILES'][c_custkey % 3 + 1] AS protocol, ['ADDRESSES', 'PARCELS', 'BUILDINGS', 'ADDRESSES'][(c_custkey // 3) % 4 + 1] AS kind,
    ['POINTS', 'POLYGONS', 'OTHER', 'POLYGONS', 'POINTS'][(c_custkey // 5) % 5 + 1] AS geometry FROM customer),
n AS (SELECT *, count(*) OVER (PARTITION BY lower(name)) > 1 AS taken FROM b) """
SQL = {
    "source_problems": _SOURCES + """SELECT id, CASE WHEN id % 17 = 0 THEN 'the layer''s address is missing' WHEN id % 19 = 0 THEN 'the layer has not been checked' WHEN name = '' THEN 'the name is missing'
        WHEN taken THEN 'another source is called ' || name WHEN protocol = 'PMTILES' AND kind <> 'ADDRESSES' THEN 'tile archives hold addresses only'
        WHEN geometry = 'POINTS' AND kind <> 'ADDRESSES' THEN 'points can be addresses only' WHEN geometry = 'OTHER' THEN 'the layer holds neither points nor polygons'
        WHEN kind = 'ADDRESSES' AND id % 3 = 0 THEN 'no field holds the housenumber' WHEN kind = 'ADDRESSES' AND id % 4 = 0 AND id % 5 <> 0 THEN 'the layer has no field Dir' END AS problem FROM n""",
    "stored_sources": _SOURCES + """SELECT id, name, kind, CASE WHEN kind = 'ADDRESSES' AND id % 3 <> 0 THEN 'NUM' END AS number, CASE WHEN kind = 'ADDRESSES' THEN CASE WHEN id % 4 = 0 THEN 'ST,Dir' ELSE 'st' END END AS street,
        CASE WHEN kind = 'PARCELS' THEN 'APN' END AS pid, CASE WHEN id % 23 <> 0 THEN (-(id % 100))::DOUBLE END AS west, CASE WHEN id % 23 <> 0 THEN 60.0::DOUBLE END AS north FROM n WHERE id % 29 <> 0""",
    "source_layers": f"""WITH d AS (SELECT p_partkey AS id, {_pick("p_partkey", _NAMES)} AS base FROM part WHERE p_partkey % 11 <> 0)
SELECT id, 'PARCELS' AS kind, base || ' parcels (lots)' AS name, 'https://p.com/' || id AS url, 'A=1' AS condition, '{{"url":"x"}}' AS licence, 'APN' AS fields FROM d UNION ALL
SELECT id, 'ADDRESSES', base || ' addresses', 'https://e.com/' || id, NULL, 'root', CASE WHEN id % 3 = 0 THEN 'HOUSE,ST,TYPE' ELSE 'PRE,HOUSE,ST,TYPE' END FROM d WHERE id % 5 <> 0 AND id % 3 <> 2""",
    "catalog_join": """WITH f AS (SELECT o_custkey % 50 AS view, o_orderkey AS place, o_orderkey % 97 AS map FROM orders),
e AS (SELECT p_partkey % 97 AS map, 'us/' || (p_partkey % 31) AS source, ['city', 'county', 'state', 'town'][p_partkey % 4 + 1] AS level, p_partkey AS seq FROM part WHERE p_partkey % 6 <> 0 AND p_partkey % 19 <> 0 AND p_partkey % 97 <> 0),
o AS (SELECT view, source, map, level, seq FROM f JOIN e USING (map) QUALIFY row_number() OVER (PARTITION BY view, source ORDER BY place, seq) = 1)
SELECT *, row_number() OVER (PARTITION BY view ORDER BY CASE WHEN level IN ('city', 'town') THEN 0 WHEN level = 'state' THEN 2 ELSE 1 END, source) AS place FROM o""",
    "extent_checks": """WITH b AS (SELECT p_partkey AS id, p_partkey % 400 - 200 AS w, p_partkey * 7 % 200 - 100 AS s, p_partkey % 400 - 200 + p_partkey % 3 - CASE WHEN p_partkey % 17 = 0 THEN 5 ELSE 0 END AS e,
  CASE WHEN p_partkey % 23 <> 0 THEN p_partkey * 7 % 200 - 100 + p_partkey % 2 END AS n FROM part)
SELECT id, coalesce(n IS NOT NULL AND abs(w) <= 180 AND abs(e) <= 180 AND abs(s) <= 90 AND abs(n) <= 90 AND w <= e AND s <= n AND (w < e OR s < n), false) AS valid FROM b""",
    "field_lists": f"SELECT p_partkey AS id, {_pick('p_partkey', ('HOUSE + STREET', 'A + B + C', 'one', '', '', 'A + B'))} AS fields FROM part",
    "esri_features": f"""SELECT id, kind, coordinates, a FROM (SELECT id, {_pick("a", ("Point", "Polygon", "LineString", None, None))} AS kind, {_pick("a", ("[1.5,2.5]", "[[[0,0],[4,0],[0,3],[0,0]]]", "[[0,0],[1,1]]", None, None))} AS coordinates, CAST(a AS BIGINT) AS a
FROM (SELECT p_partkey AS id, unnest([p_partkey, p_partkey + 1]) AS a FROM part)) WHERE kind IS NOT NULL""",
    "point_layers": """SELECT layer, bool_and(kind = 'Point') AND layer % 2 = 0 AS wrong FROM (SELECT p_partkey % 100 AS layer, CASE WHEN p_partkey % 100 % 3 = 0 AND p_partkey % 700 = p_partkey % 100 THEN 'Polygon' ELSE 'Point' END AS kind FROM part) GROUP BY layer""",
    "source_addresses": f"""SELECT p_partkey AS id, {_pick("p_partkey", ADDRESSES[:3] + ("https://raw.githubusercontent.com/openaddresses/openaddresses/master/sources/us/ca/kern.json", "http://e.com/x.json"))} AS address,
{_pick("p_partkey", ("https://e.com/a.pmtiles", "https://e.com/b.pmtiles", "https://e.com/c.pmtiles", "US/CA/Kern", " http://e.com/x.json "))} AS file, {_pick("p_partkey", ("land use", None, None, None, None))} AS layer FROM part""",
}
