"""Queries of all checks together, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions import address as A
from plotline.operators import chains as C
from plotline.operators import validation as V
from plotline.plans import chain_queries, quality_queries, town
from plotline.plans.match_queries import SETTINGS
from plotline.spread import stored

BOUNDS = (-100.0, -100.0, 600.0, 100000.0)


def _context(spark, sf_dir) -> dict:
    """Addresses, roads and buildings of the town, and its addresses along chains of roads."""
    ways = stored(chain_queries._roads(spark, sf_dir, lambda x, y: (x, y)), "ways")
    chains = C.dead_ends(stored(C.road_chains(ways), "chains"), ways)
    addresses = stored(quality_queries._addresses(spark, sf_dir), "addresses")
    bounds = spark.range(1).select(*[F.lit(v).alias(c) for c, v in zip(("dxmin", "dymin", "dxmax", "dymax"), BOUNDS)])
    return {
        "addresses": addresses,
        "roads": stored(quality_queries._roads(spark, sf_dir), "roads"),
        "buildings": stored(A.with_normal(town.buildings(spark, sf_dir, SETTINGS), "b_"), "buildings"),
        "placed": stored(C.placed_on_chains(addresses, stored(C.chain_pieces(chains), "pieces")), "placed"),
        "bounds": bounds,
    }


def validation_findings(spark, sf_dir) -> DataFrame:
    found = V.findings(**_context(spark, sf_dir))
    return found.withColumn("code", F.col("code").cast("long")).withColumn("related", F.array_join("related", ","))


def validation_counts(spark, sf_dir) -> DataFrame:
    found = V.findings(**_context(spark, sf_dir))
    return found.groupBy(F.col("code").cast("long").alias("code"), "severity", "message").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("element").alias("elements"))


def street_fixes(spark, sf_dir) -> DataFrame:
    """Spellings to take over from neighbours, where eight of nine spell alike."""
    addresses = quality_queries._addresses(spark, sf_dir, lambda k: F.when(k % 9 == 0, 0).otherwise(1))
    return V.street_fixes(addresses, quality_queries._roads(spark, sf_dir))


QUERIES = {f.__name__: f for f in (validation_findings, validation_counts, street_fixes)}


def _leaves(radius: int) -> str:
    x0, y0, x1, y1 = BOUNDS
    return f"(x - {radius} < {x0} OR x + {radius} > {x1} OR y - {radius} < {y0} OR y + {radius} > {y1})"


_TEXT = {code: f"'{text}'" for code, text in V.MESSAGES.items()}
_EDGED = {code: f"CASE WHEN {_leaves(int(C.RADIUS))} THEN '{text}{V.AT_EDGE}' ELSE '{text}' END" for code, text in V.MESSAGES.items()}
_NEIGHBOURS = """,
nb2 AS (SELECT b.id, b.key, o.id AS oid, o.ns AS nkey, o.street AS spelling,
    row_number() OVER (PARTITION BY b.id ORDER BY sqrt((o.x - b.x) ** 2 + (o.y - b.y) ** 2), o.id) AS rn
  FROM b2 b JOIN ad o ON o.id <> b.id AND (o.x - b.x) ** 2 + (o.y - b.y) ** 2 <= 3600 AND sign(o.y - b.ay) = b.side QUALIFY rn <= 6),
ag AS (SELECT n.* FROM nb2 n JOIN bv USING (id) WHERE bv.total >= 4 AND bv.other <> bv.ns AND bv.agree >= 0.75 * bv.total AND bv.other = bv.key AND n.nkey = bv.other),
sp2 AS (SELECT id, trim(spelling) AS spelling, count(*) AS having_it, min(rn) AS first, sum(count(*)) OVER (PARTITION BY id) AS total FROM ag GROUP BY id, trim(spelling)),
cm AS (SELECT * FROM sp2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY having_it DESC, first) = 1)
"""
_CTES = chain_queries._CTES + _NEIGHBOURS + f""",
rel AS (SELECT id, list('n' || oid) AS near FROM ag GROUP BY id),
seen AS (SELECT id, bool_or(street = name) AS exact, arg_min({{'n': name, 'r': road_id}}, struct_pack(d := distance, r := road_id)) FILTER (ns = key) AS close FROM near WHERE distance <= 200 GROUP BY id),
st AS (SELECT ad.*, close FROM ad LEFT JOIN seen USING (id) WHERE NOT coalesce(exact, false)),
cs AS (SELECT *, lag(id) OVER o AS i0, lead(id) OVER o AS i1 FROM cp WINDOW o AS (PARTITION BY road_id, side ORDER BY m, id)),
sq2 AS (
  SELECT ce.id, CASE WHEN h0 <= h1 THEN i0 ELSE i1 END AS l, CASE WHEN h0 <= h1 THEN i1 ELSE i0 END AS h FROM ce JOIN cs USING (id)
  WHERE n >= 3 AND dir <> 0 AND dir * h0 < dir * h1 AND ((dir * ce.house < dir * h0 AND ce.m - m0 >= 8) OR (dir * ce.house > dir * h1 AND m1 - ce.m >= 8))),
pa AS (
  SELECT id, house FROM (SELECT *, count(*) OVER s AS k, count(*) FILTER (house % 2 = 0) OVER s AS e FROM cp WINDOW s AS (PARTITION BY road_id, side))
  WHERE k >= 4 AND house % 2 <> CASE WHEN e >= 0.8 * k THEN 0 WHEN k - e >= 0.8 * k THEN 1 END),
dif AS (
  SELECT sm.id, bid, CASE WHEN inside >= 2 OR (ns <> '' AND bns <> '' AND ns <> bns AND area >= 500) THEN 'OTHER' ELSE 'WARNING' END AS severity
  FROM sm JOIN ins USING (bid) WHERE b_exact IS NOT NULL AND (nn <> bnn OR (ns <> '' AND bns <> '' AND ns <> bns))),
found AS (
  SELECT 47100 AS code, 'WARNING' AS severity, {_TEXT[47100]} AS message, 'building=' || building || ' carries an address but no amenity, shop or office tag' AS detail, 'b' || bid AS element, ''::VARCHAR AS related
  FROM buildings WHERE b_exact IS NOT NULL AND factor < 1 UNION ALL
  SELECT 47102, 'WARNING', {_TEXT[47102]}, 'addr:street=' || street || ', road name=' || close.n, 'n' || id, 'w' || close.r FROM st WHERE close IS NOT NULL UNION ALL
  SELECT CASE WHEN {_leaves(200)} THEN 47103 ELSE 47101 END, 'WARNING', CASE WHEN {_leaves(200)} THEN {_TEXT[47103]} ELSE {_TEXT[47101]} END, 'addr:street=' || street, 'n' || id, '' FROM st WHERE close IS NULL UNION ALL
  SELECT 47104, 'WARNING', {_EDGED[47104]}, a.number || ' between ' || b.number || ' and ' || c.number || ' on ' || a.street, 'n' || a.id, array_to_string(list_sort(['n' || l, 'n' || h]), ',')
  FROM sq2 JOIN (SELECT id, number, street, x, y FROM ad) a USING (id) JOIN (SELECT id, number FROM ad) b ON b.id = l JOIN (SELECT id, number FROM ad) c ON c.id = h UNION ALL
  SELECT 47105, 'WARNING', {_EDGED[47105]}, number || ' on the ' || CASE WHEN pa.house % 2 = 0 THEN 'odd' ELSE 'even' END || ' side of ' || street, 'n' || id, '' FROM pa JOIN ad USING (id) UNION ALL
  SELECT 47106, 'WARNING', {_TEXT[47106]}, 'addr:street=' || street || ', neighbours use ' || spelling, 'n' || id, array_to_string(list_sort(near), ',') FROM cm JOIN ad USING (id) JOIN rel USING (id) UNION ALL
  SELECT 47107, severity, {_TEXT[47107]}, 'node ' || number || ' ' || street || ', building ' || coalesce(b_number, '') || ' ' || coalesce(b_street, ''), 'n' || id, 'b' || bid FROM dif JOIN ad USING (id) JOIN buildings USING (bid))
"""
SQL = {
    "validation_findings": _CTES + "SELECT code::BIGINT AS code, severity, message, detail, element, related FROM found",
    "validation_counts": _CTES + "SELECT code::BIGINT AS code, severity, message, count(*) AS n, count(DISTINCT element) AS elements FROM found GROUP BY ALL",
    "street_fixes": quality_queries._base("CASE WHEN {k} % 9 = 0 THEN 0 ELSE 1 END") + _NEIGHBOURS + "SELECT id, street AS was, spelling AS street FROM cm JOIN ad USING (id) WHERE having_it >= 0.75 * total AND street IS DISTINCT FROM spelling",
}
