"""Queries of sources, tiles, edits and lineage state, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions import geometry as G
from plotline.functions import web as W
from plotline.operators import edits as E
from plotline.operators.settings import MatchSettings, address_carrier, plain_address_node
from plotline.plans.match_queries import Town
from plotline.plans.match_sql import match_ctes
from plotline.plans.text_queries import _tags
from plotline.plans.town import table

ZOOM = 12


def _lonlat(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 37 % 3500) / 10.0 - 175).alias("lon"), ((k * 53 % 1600) / 10.0 - 80).alias("lat"))


def project_xy(spark, sf_dir) -> DataFrame:
    d = _lonlat(spark, sf_dir)
    x, y = G.project(F.col("lon"), F.col("lat"), F.lit(-112.175), F.lit(33.565))
    lon, lat = G.unproject(x, y, F.lit(-112.175), F.lit(33.565))
    return d.select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def extent_centroid(spark, sf_dir) -> DataFrame:
    a = Town(spark, sf_dir).addresses
    return a.agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def tile_cover(spark, sf_dir) -> DataFrame:
    """Tiles that cover a box of 0.2 by 0.1 degrees round each point."""
    d = _lonlat(spark, sf_dir)
    xs = F.sequence(G.tile_x(F.col("lon"), ZOOM), G.tile_x(F.col("lon") + 0.2, ZOOM))
    ys = F.sequence(G.tile_y(F.col("lat") + 0.1, ZOOM), G.tile_y(F.col("lat"), ZOOM))
    return d.withColumn("tx", F.explode(xs)).withColumn("ty", F.explode(ys)).select("id", "tx", "ty")


def hilbert_tile_id(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), G.hilbert_tile(6, k % 64, (k * 29) % 64).alias("tile"))


def great_circle(spark, sf_dir) -> DataFrame:
    return _lonlat(spark, sf_dir).select("id", F.round(G.great_circle(F.col("lon"), F.col("lat"), F.lit(0.0), F.lit(0.0)), 3).alias("metres"))


def mercator_inverse(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    x, y = (k * 7919 % 20000 - 10000) * 1000.0, (k * 104729 % 20000 - 10000) * 1000.0
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.round(G.mercator_to_lon(x), 6).alias("lon"), F.round(G.mercator_to_lat(y), 6).alias("lat"))


def largest_ring_centroid(spark, sf_dir) -> DataFrame:
    """Centre of the largest of three triangles made from each part's keys."""
    j, s = F.col("p_partkey").cast("double"), F.col("p_size").cast("double")

    def tri(dx, size):
        p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        return F.array(p(j + dx, s), p(j + dx + size, s), p(j + dx, s + size * 2), p(j + dx, s))

    rings = F.array(tri(0.0, s % 7 + 1), tri(100.0, s % 11 + 1), tri(200.0, s % 5 + 1))
    best = F.array_max(F.transform(rings, lambda r: F.struct(G.ring_area(r).alias("area"), G.ring_centroid(r).alias("c"))))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(best["area"], 6).alias("area"), F.round(best["c"]["x"], 6).alias("cx"), F.round(best["c"]["y"], 6).alias("cy"))


def conform_concat(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), W.conformed(F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).otherwise(F.col("p_type")), F.col("p_size")).alias("value"))


def conform_json(spark, sf_dir) -> DataFrame:
    """A field of each event's properties as text, blanks as nothing."""
    return table(spark, sf_dir, "events").select("event_id", W.conformed(F.get_json_object("props", "$.k")).alias("k"))


URLS = (
    "https://gis.example.com/arcgis/rest/services/A/FeatureServer/0/query?where=1", "see https://x.example.org/collections/addr/items?limit=5&key=abc&bbox=1 now", "https://t.example.net/a.pmtiles#layer",
    "plain text", "https://m.example.com/MapServer/12/", "http://o.example.com/collections/c?f=json", "https://example.com/page",
)


def service_urls(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    url = F.element_at(F.array(*[F.lit(u) for u in URLS]), (k % len(URLS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("id"), W.clean_url(url).alias("layer"), W.protocol(W.clean_url(url)).alias("protocol"))


def layer_kinds(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    title = F.element_at(F.array(*[F.lit(t) for t in ("Building footprints", "Tax Lots", "Situs points", "Layer", "")]), (k % 5 + 1).cast("int"))
    geometry = F.element_at(F.array(F.lit("POINTS"), F.lit("POLYGONS"), F.lit(None)), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("id"), W.suggested_kind(title, F.lit("https://example.com/x?parcel=1"), geometry).alias("kind"))


def field_match(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    sets = ["OBJECTID,House_Number,ST_NAME", "FID,num,FULLNAME,Road", "id,AddNum,street", "x,y"]
    fields = F.split(F.element_at(F.array(*[F.lit(s) for s in sets]), (k % 4 + 1).cast("int")), ",")
    number, street = ("housenumber", "house_number", "addnum", "number", "num"), ("fullname", "streetname", "stname", "street", "road")
    return table(spark, sf_dir, "part").select(k.alias("id"), W.guessed_field(fields, number).alias("number"), W.guessed_field(fields, street).alias("street"))


def catalog_rank(spark, sf_dir) -> DataFrame:
    """Datasets of the nations, one per source (the first), cities before others before states."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("map"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"))
    source = F.concat(F.lit("us/"), F.when(F.col("map") % 3 == 0, "city_of_").when(F.col("map") % 3 == 1, "county_").otherwise("statewide_"), F.lower("segment"))
    rank = F.when(F.col("map") % 3 == 0, 0).when(F.col("map") % 3 == 1, 1).otherwise(2)
    return c.withColumn("source", source).withColumn("rank", rank).groupBy("source", "rank").agg(F.min("id").alias("id"))


def seam_dedup(spark, sf_dir) -> DataFrame:
    """Points of neighbouring tiles: of a point on a seam that both hold, one stays."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("id"), F.floor(k / 2).alias("px"), (k % 3).alias("prop"), (k % 2 == 1).alias("seam"))
    inner, seam = p.where("NOT seam"), p.where("seam").groupBy("px", "prop").agg(F.min("id").alias("id"))
    edge = inner.select(F.col("px").alias("_x"), F.col("prop").alias("_p")).distinct()
    kept = seam.join(edge, (F.col("px") == F.col("_x")) & (F.col("prop") == F.col("_p")), "left_anti")
    return inner.select("id", "px", "prop").unionByName(kept.select("id", "px", "prop"))


def plain_nodes(spark, sf_dir) -> DataFrame:
    """Which of the town's address nodes are nothing but addresses, and which carry one."""
    k = F.col("id")
    a = _tags(Town(spark, sf_dir).addresses, "").withColumn("tags", F.map_filter("tags", lambda t, v: t != "building"))
    more = F.when(k % 4 == 0, F.create_map(F.lit("source:date"), F.lit("2020"))).when(k % 4 == 1, F.create_map(F.lit("amenity"), F.lit("cafe"))).when(k % 4 == 2, F.create_map(F.lit("building"), F.lit("shed"))).otherwise(F.create_map().cast("map<string,string>"))
    tags = F.map_concat("tags", more)
    return a.select("id", plain_address_node(tags).alias("plain"), address_carrier(tags, MatchSettings()).alias("carrier"))


def _edits(spark, sf_dir) -> DataFrame:
    t = Town(spark, sf_dir)
    groups = _tags(t.groups, "")
    b = _tags(t.buildings, "b_").select(F.col("bid").alias("_b"), F.col("b_tags").alias("target_tags"))
    tags = t.proposals.select(F.col("id").alias("_i"), F.col("target").alias("_t")).join(b, F.col("_t") == F.col("_b")).select("_i", "target_tags")
    return E.edits(t.final, groups.join(tags, F.col("id") == F.col("_i"), "left"))


def apply_edits(spark, sf_dir) -> DataFrame:
    tags = F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return _edits(spark, sf_dir).select("id", F.col("step").cast("long").alias("step"), "layer", "op", "pkey", tags.alias("tags"))


def edit_counts(spark, sf_dir) -> DataFrame:
    return _edits(spark, sf_dir).groupBy("layer", "op").agg(F.count(F.lit(1)).alias("n"))


def applied_state(spark, sf_dir) -> DataFrame:
    """The events as a log: purchases and signups apply, others undo."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("proposal"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_id") % 3 < 2, 1).otherwise(-1).alias("delta"))
    return E.applied_states(log).select("proposal", F.col("seq.event_id").alias("event_id"), "change", "count")


def proposal_reverse_index(spark, sf_dir) -> DataFrame:
    t = Town(spark, sf_dir)
    cells = t.groups.select(F.col("id").alias("_g"), "cell_id")
    return E.reverse_index(t.final.join(cells, F.col("id") == F.col("_g")), t.ranked.select("id", "bid"))


QUERIES = {
    f.__name__: f
    for f in (
        project_xy, extent_centroid, tile_cover, hilbert_tile_id, great_circle, mercator_inverse, largest_ring_centroid, conform_concat, conform_json, service_urls, layer_kinds,
        field_match, catalog_rank, seam_dedup, plain_nodes, apply_edits, edit_counts, applied_state, proposal_reverse_index,
    )
}

_LL = "(SELECT c_custkey AS id, (c_custkey * 37 % 3500) / 10.0::DOUBLE - 175 AS lon, (c_custkey * 53 % 1600) / 10.0::DOUBLE - 80 AS lat FROM customer)"
_N = 1 << ZOOM
_TX = f"greatest(0, least({_N - 1}, CAST(floor(({{lon}} + 180) / 360 * {_N}) AS BIGINT)))"
_TY = f"greatest(0, least({_N - 1}, CAST(floor((1 - ln(tan(radians({{lat}})) + 1 / cos(radians({{lat}}))) / {math.pi}) / 2 * {_N}) AS BIGINT)))"
_URLS = "[" + ", ".join(f"'{u}'" for u in URLS) + "]"
_CLEANED = (
    "https://gis.example.com/arcgis/rest/services/A/FeatureServer/0", "https://x.example.org/collections/addr?key=abc", "https://t.example.net/a.pmtiles#layer",
    "plain text", "https://m.example.com/MapServer/12", "http://o.example.com/collections/c", "https://example.com/page",
)
_PROTOCOLS = ("'ARCGIS'", "'OGC_FEATURES'", "'PMTILES'", "NULL", "'ARCGIS'", "'OGC_FEATURES'", "NULL")


def _hilbert_sql() -> str:
    """Level by level, from the top: quadrant, then the turn of the rest."""
    steps = ["h6 AS (SELECT c_custkey AS id, CAST((4 ** 6 - 1) / 3 AS BIGINT) AS d, c_custkey % 64 AS x, (c_custkey * 29) % 64 AS y FROM customer)"]
    for level in range(5, -1, -1):
        s = 1 << level
        steps.append(
            f"h{level} AS (SELECT id, d + {s * s} * xor(3 * (x // {s}), y // {s}) AS d, "
            f"CASE WHEN y // {s} = 0 THEN CASE WHEN x // {s} = 1 THEN {s - 1} - y % {s} ELSE y % {s} END ELSE x % {s} END AS x, "
            f"CASE WHEN y // {s} = 0 THEN CASE WHEN x // {s} = 1 THEN {s - 1} - x % {s} ELSE x % {s} END ELSE y % {s} END AS y FROM h{level + 1})"
        )
    return "WITH " + ", ".join(steps) + " SELECT id, CAST(d AS BIGINT) AS tile FROM h0"


_ADDR_TAGS = "'addr:housenumber=' || number || ';addr:street=' || street || coalesce(';addr:unit=' || unit, '')"
_EDITS = f"""WITH {match_ctes()},
eg AS (SELECT f.*, g.number, g.street, g.unit, b.b_number, b.b_street, b.b_unit, b.b_exact FROM final f JOIN groups g USING (id) LEFT JOIN buildings b ON bid = f.target),
ap AS (SELECT * FROM eg WHERE (bucket IN ('CLEAN', 'FILL_EXISTING', 'MULTI_ADDRESS_BUILDING', 'REVIEW', 'NO_BUILDING', 'AMBIGUOUS_BUILDING') OR (bucket = 'EXISTING_ADDRESS' AND kind = 'IDENTICAL'))
  AND NOT (bucket = 'AMBIGUOUS_BUILDING' AND target IS NULL)),
fl AS (SELECT id, target, array_to_string(list_filter([CASE WHEN b_number IS NULL THEN 'addr:housenumber=' || number END, CASE WHEN b_street IS NULL THEN 'addr:street=' || street END,
  CASE WHEN b_unit IS NULL THEN 'addr:unit=' || unit END], lambda q: q IS NOT NULL), ';') AS tags FROM ap WHERE (bucket = 'FILL_EXISTING' OR (bucket = 'CLEAN' AND kind IS NOT NULL)) AND target IS NOT NULL),
ed AS (
  SELECT id, CAST(1 AS BIGINT) AS step, 'target' AS layer, 'set_tags' AS op, 'b' || target AS pkey, tags FROM fl WHERE tags <> '' UNION ALL
  SELECT id, 1, 'target', 'set_tags', 'b' || target, {_ADDR_TAGS} FROM ap WHERE kind IS NULL AND bucket IN ('CLEAN', 'REVIEW', 'AMBIGUOUS_BUILDING') AND NOT keeps_node UNION ALL
  SELECT id, 1, 'target', 'add_node', 'n' || id, {_ADDR_TAGS} FROM ap WHERE kind IS NULL AND (bucket IN ('NO_BUILDING', 'MULTI_ADDRESS_BUILDING') OR keeps_node) UNION ALL
  SELECT ap.id, 2, 'source', 'delete_node', 'n' || l.id, '' FROM ap JOIN groups g USING (id) JOIN located l ON l.exact = g.exact AND l.cell_id IS NOT DISTINCT FROM g.cell_id)
"""
SQL = {
    "project_xy": f"""SELECT id, round((lon + 112.175::DOUBLE) * 111320.0::DOUBLE * cos(radians(33.565::DOUBLE)), 3) AS x, round((lat - 33.565::DOUBLE) * 110540.0::DOUBLE, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM {_LL}""",
    "extent_centroid": f"WITH {match_ctes()} SELECT round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM addresses",
    "tile_cover": f"""SELECT id, tx, ty FROM (SELECT id, unnest(range({_TX.format(lon='lon')}, {_TX.format(lon='(lon + 0.2::DOUBLE)')} + 1)) AS tx, lat FROM {_LL}),
        unnest(range({_TY.format(lat='(lat + 0.1::DOUBLE)')}, {_TY.format(lat='lat')} + 1)) AS t(ty)""",
    "hilbert_tile_id": _hilbert_sql(),
    "great_circle": f"SELECT id, round(2 * 6378137.0::DOUBLE * asin(sqrt(sin(radians(-lat) / 2) ** 2 + cos(radians(lat)) * sin(radians(-lon) / 2) ** 2)), 3) AS metres FROM {_LL}",
    "mercator_inverse": f"""SELECT id, round(degrees(x / 6378137.0::DOUBLE), 6) AS lon, round(degrees(2 * atan(exp(y / 6378137.0::DOUBLE)) - {math.pi} / 2), 6) AS lat
        FROM (SELECT c_custkey AS id, (c_custkey * 7919 % 20000 - 10000) * 1000.0::DOUBLE AS x, (c_custkey * 104729 % 20000 - 10000) * 1000.0::DOUBLE AS y FROM customer)""",
    "largest_ring_centroid": """WITH t AS (SELECT p_partkey AS id, CAST(p_partkey AS DOUBLE) AS j, CAST(p_size AS DOUBLE) AS s, d, CASE d WHEN 0 THEN p_size % 7 + 1 WHEN 100 THEN p_size % 11 + 1 ELSE p_size % 5 + 1 END AS n
        FROM part, unnest([0, 100, 200]) AS u(d)) SELECT id, round(n * n * 1.0, 6) AS area, round(j + d + n / 3.0::DOUBLE, 6) AS cx, round(s + 2 * n / 3.0::DOUBLE, 6) AS cy FROM t
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, d DESC) = 1""",
    "conform_concat": "SELECT p_partkey AS id, trim(p_brand) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || trim(p_type) END || ' ' || p_size AS value FROM part",
    "conform_json": "SELECT event_id, nullif(trim(json_extract_string(props, '$.k')), '') AS k FROM events",
    "service_urls": f"SELECT p_partkey AS id, [{', '.join(repr(u) for u in _CLEANED)}][p_partkey % 7 + 1] AS layer, [{', '.join(_PROTOCOLS)}][p_partkey % 7 + 1] AS protocol FROM part",
    "layer_kinds": """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'ADDRESSES' WHEN p_partkey % 5 = 0 THEN 'BUILDINGS' WHEN p_partkey % 5 = 1 THEN 'PARCELS' WHEN p_partkey % 5 = 2 THEN 'ADDRESSES'
        WHEN p_partkey % 3 = 1 THEN 'PARCELS' END AS kind FROM part""",
    "field_match": """SELECT p_partkey AS id, ['House_Number', 'num', 'AddNum', NULL][p_partkey % 4 + 1] AS number, ['ST_NAME', 'FULLNAME', 'street', NULL][p_partkey % 4 + 1] AS street FROM part""",
    "catalog_rank": """SELECT 'us/' || CASE c_nationkey % 3 WHEN 0 THEN 'city_of_' WHEN 1 THEN 'county_' ELSE 'statewide_' END || lower(c_mktsegment) AS source, CAST(c_nationkey % 3 AS INT) AS rank, min(c_custkey) AS id
        FROM customer GROUP BY 1, 2""",
    "seam_dedup": """WITH p AS (SELECT c_custkey AS id, c_custkey // 2 AS px, c_custkey % 3 AS prop, c_custkey % 2 = 1 AS seam FROM customer)
        SELECT id, px, prop FROM p WHERE NOT seam UNION ALL SELECT min(id), px, prop FROM p a WHERE seam AND NOT EXISTS (SELECT 1 FROM p b WHERE NOT b.seam AND b.px = a.px AND b.prop = a.prop) GROUP BY px, prop""",
    "plain_nodes": "SELECT c_custkey AS id, c_custkey % 4 IN (0, 3) AS plain, c_custkey % 4 IN (0, 3) AS carrier FROM customer",
    "apply_edits": _EDITS + "SELECT id, step, layer, op, pkey, tags FROM ed",
    "edit_counts": _EDITS + "SELECT layer, op, count(*) AS n FROM ed GROUP BY layer, op",
    "applied_state": """WITH l AS (SELECT user_id AS proposal, event_id, ts, CASE WHEN event_id % 3 < 2 THEN 1 ELSE -1 END AS delta FROM events),
        s AS (SELECT *, sum(delta) OVER w AS r FROM l WINDOW w AS (PARTITION BY proposal ORDER BY ts, event_id)),
        c AS (SELECT *, r - least(min(r) OVER w, 0) AS n FROM s WINDOW w AS (PARTITION BY proposal ORDER BY ts, event_id)),
        b AS (SELECT *, coalesce(lag(n) OVER w, 0) AS was FROM c WINDOW w AS (PARTITION BY proposal ORDER BY ts, event_id))
        SELECT proposal, event_id, CASE WHEN n = 0 THEN 'undone' ELSE 'redone' END AS change, CAST(n AS BIGINT) AS count FROM b WHERE (n = 0 AND was > 0) OR (n > 0 AND was = 0)""",
    "proposal_reverse_index": f"""WITH {match_ctes()} SELECT 'address' AS role, 'n' || id AS pkey, id AS proposal FROM final UNION SELECT 'building', 'b' || target, id FROM final WHERE target IS NOT NULL
        UNION SELECT 'parcel', cell_id, id FROM final JOIN (SELECT id, cell_id FROM groups) USING (id) WHERE cell_id IS NOT NULL
        UNION SELECT 'building', 'b' || bid, id FROM ranked WHERE id IN (SELECT id FROM final WHERE bucket = 'AMBIGUOUS_BUILDING')""",
}
