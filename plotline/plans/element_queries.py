"""Queries over tags, names and street relations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions import names as N
from plotline.operators import elements as E
from plotline.operators import quality as Q
from plotline.operators.settings import POI_KEYS, MatchSettings
from plotline.plans import quality_queries, sqltext, town
from plotline.plans.town import table

VALUES = {
    "building": ("yes", "no", "garage", None, "house", None, None), "addr:housenumber": ("1", None, "2b"), "highway": ("residential", None, "footway", "service", None, "trunk_link", None, None, None, "track", None),
    "railway": (None, None, "rail", None, "abandoned"), "shop": (None,) * 12 + ("bakery",), "entrance": (None,) * 16 + ("main",), "oa:pid": (None, None, None, "P1"), "source": ("county", None),
    "name": ("Oak Street;Elm  Street", None, "Mt Hope", None), "name:etymology": (None, "x"), "alt_name": (None, None, "Old Road"),
}


def _tagged(spark, sf_dir) -> DataFrame:
    k = F.col("id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    tags = F.map_filter(F.create_map(*[x for key, values in VALUES.items() for x in (F.lit(key), pick(values))]), lambda key, v: v.isNotNull())
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).withColumn("tags", tags)
    return rows.withColumns({"x": F.when(k % 29 != 0, (k % 100).cast("double")), "y": (k % 37).cast("double")})


def _ways(spark, sf_dir) -> DataFrame:
    """Ways through every fifth of the nodes."""
    k = F.col("p_partkey")
    blocks = table(spark, sf_dir, "part").groupBy(F.floor(k / 5).alias("b")).agg(F.max(k).alias("k"))
    return blocks.select(F.col("b").alias("way_id"), F.array("k", F.col("k") + 1_000_000).alias("nodes"))


def tag_predicates(spark, sf_dir) -> DataFrame:
    t = F.col("tags")
    return _tagged(spark, sf_dir).select(
        "id", E.is_building(t).alias("building"), E.is_road(t).alias("road"), E.divides(t).alias("divides"), E.free_of_features(t).alias("plain"), F.round(MatchSettings().tag_weight(t), 6).alias("weight")
    )


def source_nodes(spark, sf_dir) -> DataFrame:
    nodes = _tagged(spark, sf_dir).withColumnRenamed("id", "node_id")
    other, same = E.source_nodes(nodes, _ways(spark, sf_dir)), E.source_nodes(nodes, _ways(spark, sf_dir), same_layer=True)
    return other.select("node_id", F.lit("other").alias("layer")).unionByName(same.select("node_id", F.lit("same").alias("layer")))


def building_node_filter(spark, sf_dir) -> DataFrame:
    nodes = _tagged(spark, sf_dir).withColumnRenamed("id", "node_id")
    return E.building_nodes(nodes, _ways(spark, sf_dir)).select("node_id")


def parcel_layers(spark, sf_dir) -> DataFrame:
    """Groups of elements that hold parcels."""
    return _tagged(spark, sf_dir).groupBy(F.floor(F.col("id") / 3).alias("layer")).agg(E.holds_parcels(F.col("tags")).alias("parcels"))


def footprint_filter(spark, sf_dir) -> DataFrame:
    rows = _tagged(spark, sf_dir).withColumn("area", (F.col("id") % 5) / 2.0)
    return E.footprints(rows, F.col("area")).select("id", "area")


def vertex_sharing(spark, sf_dir) -> DataFrame:
    """Polygon vertices that are equal at seven digits."""
    k = F.col("p_partkey")
    points = table(spark, sf_dir, "part").select(k.alias("owner"), F.lit(0).alias("i"), (k % 10 / 8 + k % 3 * 1e-9).alias("lon"), (k % 7 / 4).alias("lat"))
    return E.shared_vertices(points).select("owner", F.col("vertex.owner").alias("shared"))


NAMES = ("Peña  Ave", "PEÑA Avenue", "Straße", "W Olive Ave.", "Улица 5", " \tOak St\n", "!!", "Å")


def name_folding(spark, sf_dir) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.canonical(name).alias("canon"))
    return rows.withColumn("fold", N.folded(F.col("canon"))).withColumn("expanded", N.expanded(F.col("fold")))


def direction_texts(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), N.direction_text((k % 9 - 4) / 4.0, (k % 5 - 2) / 50.0).alias("text"), N.short_hash(k.cast("string")).alias("hash"))


# ---- street relations ----


def _roads(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The town's roads with tags, and street relations of every fourth of them."""
    roads = quality_queries._roads(spark, sf_dir)
    tags = F.create_map(F.lit("highway"), F.lit("residential"), F.lit("name"), F.col("name"), F.lit("name:etymology"), F.lit("Nobody"))
    relations = roads.where(F.col("road_id") % 4 == 0).select(
        F.col("road_id").alias("rel_id"), F.create_map(F.lit("type"), F.when(F.col("road_id") % 8 == 0, "associatedStreet").otherwise("street"), F.lit("name"), F.concat(F.lit("Former "), (F.col("road_id")).cast("string"))).alias("tags")
    )
    return roads.withColumn("tags", tags), relations, relations.select("rel_id", F.col("rel_id").alias("road_id"))


def road_name_lists(spark, sf_dir) -> DataFrame:
    roads, relations, members = _roads(spark, sf_dir)
    return Q.road_names(roads, relations, members)


def street_parts_check(spark, sf_dir) -> DataFrame:
    """Streets of several parts, streets that only a relation names, members of street
    relations, and the edge of the download."""
    roads, relations, members = _roads(spark, sf_dir)
    k = F.col("id")
    a = quality_queries._addresses(spark, sf_dir)
    row = F.floor(k / 40).cast("long")
    more = F.when(k % 5 == 0, ";Nowhere Lane").when(k % 7 == 0, F.concat(F.lit("; Former "), (row - row % 4).cast("string"))).otherwise("")
    a = a.withColumn("street", F.concat("street", more))
    exempt = a.where(k % 10 == 0).select("id", F.lit("nowhere  LANE").alias("name"))
    bounds = table(spark, sf_dir, "region").where("r_regionkey = 0").select(*[F.lit(v).alias(c) for c, v in zip(("dxmin", "dymin", "dxmax", "dymax"), (-100.0, -1000.0, 700.0, 1e7))])
    return Q.street_names(a, roads, 40.0, Q.road_names(roads, relations, members), exempt, bounds)


QUERIES = {
    f.__name__: f
    for f in (
        tag_predicates, source_nodes, building_node_filter, parcel_layers, footprint_filter, vertex_sharing, name_folding, direction_texts, road_name_lists, street_parts_check,
    )
}


def _lit(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _value(key: str, k: str = "id") -> str:
    values = VALUES[key]
    return "[" + ", ".join(map(_lit, values)) + f"][{k} % {len(values)} + 1]"


_B, _H, _R, _N = _value("building"), _value("highway"), _value("railway"), _value("addr:housenumber")
_P = "WITH p AS (SELECT p_partkey AS id FROM part), v AS (SELECT max(p_partkey) AS id FROM part GROUP BY p_partkey // 5) "
_ROADS = "('motorway','motorway_link','trunk','trunk_link','primary','primary_link','secondary','secondary_link','tertiary','tertiary_link','unclassified','residential','living_street','service','pedestrian','track','busway','road')"
_PLAIN = "id % 13 <> 12 AND id % 17 <> 16 AND " + _value("name") + " IS NULL"


def _key(c: str) -> str:
    return sqltext.street(f"strip_accents(lower({c}))")


SQL = {
    "tag_predicates": f"""{_P} SELECT id, coalesce({_B} <> 'no', false) AS building, coalesce({_H} IN {_ROADS}, false) AS road,
  coalesce({_H} IN ('residential', 'trunk_link'), false) OR (coalesce({_R} = 'rail', false) AND {_B} IS NULL) AS divides, {_PLAIN} AS plain,
  CASE WHEN id % 13 = 12 THEN 1.0 WHEN {_B} = 'garage' THEN 0.1 ELSE 1.0 END::DOUBLE AS weight FROM p""",
    "source_nodes": f"""{_P}, s AS (SELECT id FROM p WHERE id % 29 <> 0 AND {_N} IS NOT NULL) SELECT id AS node_id, 'other' AS layer FROM s UNION ALL
  SELECT id, 'same' FROM s WHERE id NOT IN (SELECT id FROM v) AND {_B} IS NULL AND {_H} IS NULL AND {_R} IS NULL AND {_value("shop")} IS NULL AND {_value("entrance")} IS NULL AND {_value("oa:pid")} IS NULL
    AND {_value("name")} IS NULL AND {_value("name:etymology")} IS NULL AND {_value("alt_name")} IS NULL""",
    "building_node_filter": f"{_P} SELECT id AS node_id FROM p WHERE coalesce({_B} <> 'no', false) AND {_N} IS NULL AND id NOT IN (SELECT id FROM v)",
    "parcel_layers": f"{_P} SELECT id // 3 AS layer, bool_or({_value('oa:pid')} IS NOT NULL) AS parcels FROM p GROUP BY 1",
    "footprint_filter": f"{_P} SELECT id, id % 5 / 2.0::DOUBLE AS area FROM p WHERE coalesce({_B} <> 'no', false) AND id % 5 >= 2",
    "vertex_sharing": "SELECT p_partkey AS owner, min(p_partkey) OVER (PARTITION BY p_partkey % 10, p_partkey % 7) AS shared FROM part",
    "name_folding": f"""WITH n AS (SELECT p_partkey AS id, lower(regexp_replace(trim(nfc_normalize([{", ".join(map(_lit, NAMES))}][p_partkey % {len(NAMES)} + 1]), ' ' || chr(9) || chr(10)), '\\s+', ' ', 'g')) AS canon FROM part),
f AS (SELECT *, strip_accents(canon) AS fold FROM n)
SELECT *, CASE WHEN NOT regexp_matches(regexp_replace(fold, '[\\x00-\\x7F]', '', 'g'), '[\\p{{L}}\\p{{Nd}}]') AND {sqltext.street("fold")} <> '' THEN {sqltext.street("fold")} END AS expanded FROM f""",
    "direction_texts": """WITH d AS (SELECT p_partkey AS id, (p_partkey % 9 - 4) / 4.0::DOUBLE AS dx, (p_partkey % 5 - 2) / 50.0::DOUBLE AS dy FROM part)
SELECT id, nullif(concat_ws(' and ', CASE WHEN abs(dx) >= 0.05 THEN ['0.0', '0.3', '0.5', '0.8', '1.0'][CAST(abs(dx) * 4 AS INT) + 1] || ' m ' || CASE WHEN dx > 0 THEN 'east' ELSE 'west' END END), '') AS text,
  substr(md5(CAST(id AS VARCHAR)), 1, 16) AS hash FROM d""",
    "road_name_lists": quality_queries._BASE + "SELECT road_id, name FROM roads UNION ALL SELECT road_id, 'Former ' || road_id FROM roads WHERE road_id % 4 = 0",
    "street_parts_check": quality_queries._BASE + f""", pt AS (SELECT id, x, y, trim(unnest(string_split(street || CASE WHEN id % 5 = 0 THEN ';Nowhere Lane' WHEN id % 7 = 0 THEN '; Former ' || (id // 40 - id // 40 % 4) ELSE '' END, ';'))) AS street FROM ad),
pe AS (SELECT DISTINCT * FROM pt WHERE NOT (street = 'Nowhere Lane' AND id % 10 = 0)),
nm AS (SELECT road_id, name FROM roads UNION ALL SELECT road_id, 'Former ' || road_id FROM roads WHERE road_id % 4 = 0),
sn AS (SELECT pe.id, pe.street, bool_or(pe.street = nm.name) AS exact, arg_min(nm.name, struct_pack(d := distance, r := near.road_id, n := nm.name)) AS close
  FROM pe JOIN near ON near.id = pe.id AND distance <= 40 JOIN nm ON nm.road_id = near.road_id AND {_key("nm.name")} = {_key("pe.street")} GROUP BY 1, 2)
SELECT id, street, CASE WHEN close IS NOT NULL THEN 'NEAR_MATCH' WHEN NOT (x - 40 >= -100 AND y - 40 >= -1000 AND x + 40 <= 700 AND y + 40 <= 10000000) THEN 'NO_ROAD_AT_EDGE' ELSE 'NO_ROAD' END AS problem, close AS road
FROM pe LEFT JOIN sn USING (id, street) WHERE NOT coalesce(exact, false)""",
}
