"""Queries of review lists and test beds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions.shapes import shape_area
from plotline.operators import describe as D
from plotline.operators import review as R
from plotline.plans import town
from plotline.plans.match_queries import Town
from plotline.plans.match_sql import select
from plotline.spread import stored


def _existing(t: Town) -> DataFrame:
    """Existing addresses of the same number in the group's cell."""
    from plotline.operators import match as M

    there = M.existing_in_cells(t.existing, t.cells).select("eid", "e_nn", "cell_id")
    return t.groups.select("id", "cell_id", "nn").join(there, "cell_id").where("nn = e_nn").select("id", "eid")


def result_order(spark, sf_dir) -> DataFrame:
    return R.in_order(stored(Town(spark, sf_dir).final.withColumn("confidence", F.round("confidence", 6)), "final")).select("id", "bucket", F.col("place").cast("long").alias("place"))


def bulk_apply(spark, sf_dir) -> DataFrame:
    final = stored(Town(spark, sf_dir).final, "final")
    applied = final.where("id % 5 = 0")
    return R.bulk(final, F.col("bucket"), applied).select("id", "bucket")


def highlight_sets(spark, sf_dir) -> DataFrame:
    """Elements to show for each proposal, and whether a selection of its own node and a building lies within."""
    t = Town(spark, sf_dir)
    shown = R.highlights(t.final, t.groups, t.ranked.select("id", "bid"), _existing(t))
    some = F.array(F.concat(F.lit("n"), F.col("id").cast("string")), F.concat(F.lit("b"), (F.col("id") - F.col("id") % 2).cast("string")))
    return shown.select("id", F.array_join(F.array_sort("elements"), ",").alias("elements"), R.within_rows(some, F.col("elements")).alias("within"))


def address_centre(spark, sf_dir) -> DataFrame:
    return R.address_centre(town.addresses(spark, sf_dir))


def match_scores(spark, sf_dir) -> DataFrame:
    """How many addresses of each bucket go to a building of their own lot."""
    t = Town(spark, sf_dir)
    lots = town.buildings(spark, sf_dir, t.settings).select("bid", F.floor((F.col("bxmin") + F.col("bxmax")) / 2 / 20 + 0.5).alias("lx"), F.floor((F.col("bymin") + F.col("bymax")) / 2 / 30 + 0.5).alias("ly"))
    truth = t.final.select("id", "target").join(lots, F.col("target") == F.col("bid")).where((F.col("lx") == F.col("id") % 40) & (F.col("ly") == F.floor(F.col("id") / 40))).select("id", "bid")
    return R.match_scores(t.final, truth)


def _tagged(spark, sf_dir) -> DataFrame:
    k = F.col("id")
    pair = lambda key, value, n: F.when(n, F.create_map(F.lit(key), value)).otherwise(F.create_map().cast("map<string,string>"))
    rows = town.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    tags = F.map_concat(
        pair("addr:housenumber", F.when(k % 10 == 0, F.lit("7B")).otherwise((100 + k).cast("string")), k % 4 != 3), pair("addr:unit", F.lit("2"), k % 3 == 0),
        pair("building", F.lit("house"), k % 5 == 0), pair("amenity", F.lit("cafe"), k % 7 == 0), pair("source", F.lit("x"), k % 2 == 0),
    )
    return rows.withColumn("tags", tags)


def _text(tags) -> F.Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def address_carriers(spark, sf_dir) -> DataFrame:
    return _tagged(spark, sf_dir).select("id", R.carrier_kind(F.col("tags")).alias("kind"))


def stripped_layer(spark, sf_dir) -> DataFrame:
    return R.stripped(_tagged(spark, sf_dir), generic=True).select("id", _text(F.col("tags")).alias("tags"))


def perturbed_layer(spark, sf_dir) -> DataFrame:
    """Addresses of the sample that is stripped in part, some of them with faults."""
    rows = _tagged(spark, sf_dir).where(F.map_contains_key("tags", "addr:housenumber") & (R.share_of(F.col("id"), "strip") < 0.6))
    return rows.select("id", _text(F.map_filter(R.perturbed(F.col("tags"), F.col("id")), lambda k, v: F.startswith(k, F.lit("addr:")))).alias("tags"))


def proposal_reasons(spark, sf_dir) -> DataFrame:
    """Why addresses were assigned to their buildings."""
    t = Town(spark, sf_dir)
    why = D.building_reasons(t.proposals, t.groups, stored(t.ranked, "ranked"), t.pairs, t.buildings, t.settings)
    return why.select("target", "proposal", "addresses", F.array_join("reasons", "; ").alias("reasons"))


def proposal_labels(spark, sf_dir) -> DataFrame:
    """The lines of a list of proposals."""
    t = Town(spark, sf_dir)
    ranked = t.ranked.groupBy(F.col("id").alias("_r")).agg(F.count(F.lit(1)).alias("candidates"))
    b = t.buildings.select(F.col("bid").alias("_b"), "building", shape_area(t.buildings, "b").alias("area"))
    rows = t.final.join(t.groups.select(F.col("id").alias("_g"), "number", "street", "unit"), F.col("id") == F.col("_g"))
    rows = rows.join(b, F.col("target") == F.col("_b"), "left").join(ranked, F.col("id") == F.col("_r"), "left")
    found = F.when(F.col("kind").isNotNull() & F.col("target").isNotNull(), F.concat(F.lit("b"), F.col("target").cast("string")))
    layer = F.when(F.col("target").isNotNull(), "building")
    said = D.described(F.col("number"), F.col("street"), F.col("unit"))
    label = D.row_label(said, F.col("bucket"), found, layer, F.col("building"), F.col("area"), F.coalesce("candidates", F.lit(0)), F.col("confidence"))
    return rows.select("id", label.alias("label"))


QUERIES = {f.__name__: f for f in (proposal_reasons, proposal_labels, result_order, bulk_apply, highlight_sets, address_centre, match_scores, address_carriers, stripped_layer, perturbed_layer)}

_ORDER = "list_position(['CLEAN','FILL_EXISTING','MULTI_ADDRESS_BUILDING','REVIEW','NO_BUILDING','AMBIGUOUS_BUILDING','EXISTING_ADDRESS','DUPLICATE','OUTSIDE_CELLS'], bucket)"
_TAGS = """WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 3 THEN CASE WHEN c_custkey % 10 = 0 THEN '7B' ELSE CAST(100 + c_custkey AS VARCHAR) END END AS number,
  CASE WHEN c_custkey % 3 = 0 THEN '2' END AS unit, c_custkey % 5 = 0 AS building, c_custkey % 7 = 0 AS cafe, c_custkey % 2 = 0 AS src FROM customer),
r AS (SELECT *, ('0x' || substr(md5('strip' || id), 1, 8))::BIGINT / 4294967296 AS strip, ('0x' || substr(md5('roll' || id), 1, 8))::BIGINT / 4294967296 AS roll, ('0x' || substr(md5('side' || id), 1, 8))::BIGINT / 4294967296 AS side FROM t) """
_SAID = "trim(coalesce(number, '?') || coalesce(' #' || unit, '') || ' ' || coalesce(street, ''))"
_REASONS = """(
  SELECT p.bid AS target, f.id AS proposal, p.n, p.nc, p.worst, p.sn, p.far, p.ls, f.cell_id, cn.c, p.inside, p.away, p.lc,
    (SELECT (bxmax - bxmin) * (bymax - bymin) FROM buildings b WHERE b.bid = p.bid) AS area, r2.area2, r2.kind2
  FROM (SELECT o.bid, count(*) AS n, count(DISTINCT o.cell_id) AS nc, max(o.ratio) AS worst, bool_or(o.snapped) AS sn, max(o.far) AS far, min(o.share) AS ls, min(o.id) AS first,
      arg_min(o.cell_id, {'s': o.share, 'c': o.cell_id}) AS lc, bool_and(r.hold) AS inside, max(g.cell_distance) AS away
    FROM opens o JOIN ranked r ON r.id = o.id AND r.rank = 1 JOIN groups g ON g.id = o.id GROUP BY o.bid) p
  JOIN groups f ON f.id = p.first JOIN (SELECT id, count(*) AS c FROM ranked GROUP BY id) cn ON cn.id = p.first
  LEFT JOIN (SELECT r.id, (bxmax - bxmin) * (bymax - bymin) AS area2, b.building AS kind2 FROM ranked r JOIN buildings b USING (bid) WHERE rank = 2) r2 ON r2.id = p.first)"""
SQL = {
    "proposal_reasons": select(
        """target, proposal, n AS addresses, concat_ws('; ',
          CASE WHEN c > 1 THEN 'Largest of ' || c || ' buildings in parcel ' || cell_id || ' (' || round(area)::BIGINT || ' m² against ' || round(area2)::BIGINT || ' m² of building=' || coalesce(kind2, '?') || ')' ELSE 'Only building in parcel ' || cell_id END,
          CASE WHEN worst > 0 THEN 'Runner-up scores ' || round(worst * 100)::BIGINT || '% of it' END,
          CASE WHEN inside THEN CASE WHEN n > 1 THEN 'All address points are inside' ELSE 'Address point is inside' END END,
          CASE WHEN sn THEN 'Address point snapped to a parcel ' || round(away)::BIGINT || ' m away' END,
          CASE WHEN nc > 1 THEN 'Covers ' || nc || ' addressed parcels' WHEN n > 1 THEN CASE WHEN worst >= 0.25 THEN n || ' addresses share the parcel with ' || c || ' buildings' ELSE n || ' addresses; each stays a node' END END,
          CASE WHEN far > 100 THEN round(far)::BIGINT || ' m from the address point' END,
          CASE WHEN nc = 1 AND worst < 0.75 AND NOT (n > 1 AND worst >= 0.25) AND far <= 100 AND ls < 1 - 0.2::DOUBLE THEN 'A parcel line splits it: only ' || round(ls * 100)::BIGINT || '% is in parcel ' || lc END) AS reasons""",
        _REASONS,
    ),
    "proposal_labels": select(
        f"""f.id, {_SAID} || CASE WHEN f.bucket IN ('CLEAN', 'FILL_EXISTING') AND f.kind IS NOT NULL AND f.target IS NOT NULL THEN CASE f.bucket WHEN 'CLEAN' THEN ' → already on b' ELSE ' → fills b' END || f.target
          WHEN f.target IS NOT NULL THEN ' → building=' || coalesce(b.building, '?') || ' (' || round((b.bxmax - b.bxmin) * (b.bymax - b.bymin))::BIGINT || ' m²)'
          WHEN f.bucket = 'AMBIGUOUS_BUILDING' AND c.n > 0 THEN ' → pick one of ' || c.n || ' buildings' ELSE '' END || '  ' || round(f.confidence * 100)::BIGINT || '%' AS label""",
        "final f JOIN groups g ON g.id = f.id LEFT JOIN buildings b ON b.bid = f.target LEFT JOIN (SELECT id, count(*) AS n FROM ranked GROUP BY id) c ON c.id = f.id",
    ),
    "result_order": select(f"id, bucket, row_number() OVER (ORDER BY {_ORDER}, CASE WHEN bucket = 'CLEAN' THEN -round(confidence, 6) ELSE round(confidence, 6) END, id) - 1 AS place", "final"),
    "bulk_apply": select("id, bucket", "final WHERE bucket IN ('CLEAN', 'FILL_EXISTING', 'MULTI_ADDRESS_BUILDING') AND id % 5 <> 0"),
    "highlight_sets": select(
        "id, array_to_string(list_sort(el), ',') AS elements, list_contains(el, 'n' || id) AND list_contains(el, 'b' || (id - id % 2)) AS within",
        """(SELECT f.id, list_distinct(list_concat((SELECT list('n' || l.id) FROM located l JOIN groups g ON g.exact = l.exact AND coalesce(g.cell_id, '') = coalesce(l.cell_id, '') WHERE g.id = f.id),
          CASE WHEN f.target IS NOT NULL THEN ['b' || f.target] ELSE [] END, coalesce(CASE WHEN f.bucket = 'AMBIGUOUS_BUILDING' THEN (SELECT list('b' || bid) FROM ranked r WHERE r.id = f.id) END, []),
          coalesce((SELECT list('e' || eid) FROM groups p JOIN cells c USING (cell_id) JOIN ne e ON ex >= cxmin AND ex <= cxmax AND ey >= cymin AND ey <= cymax AND e.e_nn = p.nn WHERE p.id = f.id), []))) AS el FROM final f)""",
    ),
    "address_centre": select("(min(x) + max(x)) / 2 AS x, (min(y) + max(y)) / 2 AS y", "addresses"),
    "match_scores": select(
        "bucket, count(*) AS n, count(target) AS assigned, count(*) FILTER (floor((bxmin + bxmax) / 40 + 0.5) = id % 40 AND floor((bymin + bymax) / 60 + 0.5) = id // 40) AS correct",
        "final LEFT JOIN buildings ON bid = target GROUP BY bucket",
    ),
    "address_carriers": _TAGS + "SELECT id, CASE WHEN number IS NULL THEN NULL WHEN building THEN 'building' WHEN cafe THEN 'poi' ELSE 'standalone' END AS kind FROM t",
    "stripped_layer": _TAGS + """SELECT id, concat_ws(';', CASE WHEN cafe THEN 'amenity=cafe' END, CASE WHEN building THEN 'building=yes' END, CASE WHEN src THEN 'source=x' END) AS tags
FROM t WHERE number IS NULL OR building OR cafe""",
    "perturbed_layer": _TAGS + """SELECT id, concat_ws(';', 'addr:housenumber=' || CASE WHEN roll < 0.15 AND number <> '7B' THEN CAST(CAST(number AS BIGINT) + CASE WHEN side < 0.5 THEN -2 ELSE 2 END AS VARCHAR) ELSE number END,
  'addr:unit=' || CASE WHEN roll < 0.15 OR roll >= 0.25 THEN unit END) AS tags FROM r WHERE number IS NOT NULL AND strip < 0.6""",
}
