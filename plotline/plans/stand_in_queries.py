"""Queries over nodes and hints in the town, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.operators import match as M
from plotline.operators import stand_ins as S
from plotline.plans import town
from plotline.plans.match_queries import SETTINGS, Town
from plotline.plans.match_sql import match_ctes
from plotline.spread import stored


def hints(spark, sf_dir) -> DataFrame:
    """Footprints of the parts that are no buildings of the town."""
    n = town.table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))  # one row
    j, lot = F.col("p_partkey"), F.col("lot")
    rows = town.table(spark, sf_dir, "part").where(j % 7 == 3).crossJoin(F.broadcast(n)).withColumn("lot", (j * 11) % F.col("n"))
    cx, cy = (lot % 40) * 20 + j % 9 - 4, F.floor(lot / 40) * 30 + j % 11 - 5
    hx, hy = 3 + F.col("p_size") % 7, 3 + F.col("p_size") % 9
    sides = {"hxmin": cx - hx, "hymin": cy - hy, "hxmax": cx + hx, "hymax": cy + hy}
    return rows.select(j.cast("long").alias("hint_id"), F.lit(1.0).alias("factor"), *[c.cast("double").alias(name) for name, c in sides.items()])


def nodes(spark, sf_dir) -> DataFrame:
    """Building nodes, one for each block of orders, one or two to a lot."""
    n = town.table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))  # one row
    o, lot = F.col("o_orderkey"), F.col("lot")
    blocks = town.table(spark, sf_dir, "orders").groupBy(F.floor(o / 40)).agg(F.min(o).alias("o_orderkey"))
    rows = blocks.crossJoin(F.broadcast(n)).withColumn("lot", (F.floor(o / 60) * 49 + 21) % F.col("n"))
    return rows.select(o.cast("long").alias("node_id"), ((lot % 40) * 20 + o % 7 - 3).cast("double").alias("mx"), (F.floor(lot / 40) * 30 + o % 11 - 5).cast("double").alias("my"))


def _diverted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = Town(spark, sf_dir)
    outlines = S.as_buildings(hints(spark, sf_dir))
    hint_cells = stored(M.building_cells(outlines, t.cells, t.groups.where("cell_id IS NOT NULL"), SETTINGS), "hint-pairs")
    ranked_hints = M.rank_buildings(t.groups, hint_cells, outlines, SETTINGS)
    rows = S.diverted(t.groups, t.ranked, t.matches, S.nodes_in_cells(nodes(spark, sf_dir), t.cells), ranked_hints, SETTINGS)
    return stored(rows, "diverted"), hint_cells


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "bucket", F.round("confidence", 6).alias("confidence"), "target")


def node_rules(spark, sf_dir) -> DataFrame:
    return _shown(S.node_proposals(_diverted(spark, sf_dir)[0]))


def hint_rules(spark, sf_dir) -> DataFrame:
    return _shown(S.hint_proposals(*_diverted(spark, sf_dir), SETTINGS))


def hint_preferred(spark, sf_dir) -> DataFrame:
    return _diverted(spark, sf_dir)[0].groupBy("via").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("cells"))


def building_nodes_in_cells(spark, sf_dir) -> DataFrame:
    return S.nodes_in_cells(nodes(spark, sf_dir), town.cells(spark, sf_dir))


QUERIES = {f.__name__: f for f in (node_rules, hint_rules, hint_preferred, building_nodes_in_cells)}

_CTES = f"""
{match_ctes()},
hint0 AS (SELECT p_partkey AS hid, (p_partkey * 11) % n AS lot, p_partkey % 9 - 4 AS ox, p_partkey % 11 - 5 AS oy, 3 + p_size % 7 AS hx, 3 + p_size % 9 AS hy FROM part, n WHERE p_partkey % 7 = 3),
hint AS (
  SELECT hid, CAST((lot % 40) * 20 + ox - hx AS DOUBLE) AS hxmin, CAST((lot // 40) * 30 + oy - hy AS DOUBLE) AS hymin,
    CAST((lot % 40) * 20 + ox + hx AS DOUBLE) AS hxmax, CAST((lot // 40) * 30 + oy + hy AS DOUBLE) AS hymax FROM hint0),
bnode AS (
  SELECT o_orderkey AS node_id, CAST((lot % 40) * 20 + o_orderkey % 7 - 3 AS DOUBLE) AS mx, CAST((lot // 40) * 30 + o_orderkey % 11 - 5 AS DOUBLE) AS my
  FROM (SELECT o_orderkey, (o_orderkey // 60 * 49 + 21) % n AS lot FROM (SELECT min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderkey // 40), n)),
bnode_cell AS (SELECT node_id, cell_id FROM bnode JOIN cells ON mx BETWEEN cxmin AND cxmax AND my BETWEEN cymin AND cymax),
hp0 AS (
  SELECT hid, cell_id, (hxmax - hxmin) * (hymax - hymin) AS area, greatest(0, least(hxmax, cxmax) - greatest(hxmin, cxmin)) * greatest(0, least(hymax, cymax) - greatest(hymin, cymin)) AS area_in
  FROM hint JOIN cells ON hxmin <= cxmax AND cxmin <= hxmax AND hymin <= cymax AND cymin <= hymax),
hp1 AS (SELECT *, area_in / area AS share FROM hp0 WHERE area_in > 0),
hhome AS (
  SELECT hid, cell_id AS home FROM hp1 WHERE share >= 1 - 0.2::DOUBLE AND cell_id IN (SELECT cell_id FROM groups WHERE cell_id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY hid ORDER BY share DESC, cell_id) = 1),
hp AS (SELECT hp1.* FROM hp1 LEFT JOIN hhome USING (hid) WHERE (home IS NULL OR home = cell_id) AND (share >= 0.1::DOUBLE OR area_in >= 20)),
hholds AS (SELECT id, hid FROM points JOIN hint ON x > hxmin AND x < hxmax AND y > hymin AND y < hymax),
hcell AS (SELECT id, hid, area_in FROM points JOIN hp USING (cell_id)),
hcand AS (
  SELECT id, hid, area_in IS NULL AS extra, hholds.id IS NOT NULL AS hold, area_in FROM hcell FULL JOIN hholds USING (id, hid)),
hscore AS (
  SELECT c.id, c.hid, extra, coalesce(area_in, (hxmax - hxmin) * (hymax - hymin)) AS base, base * CASE WHEN hold THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS score,
    sqrt(greatest(hxmin - x, 0, x - hxmax) ** 2 + greatest(hymin - y, 0, y - hymax) ** 2) AS far
  FROM hcand c JOIN hint USING (hid) JOIN points p ON p.id = c.id),
hrank AS (
  SELECT *, row_number() OVER o AS rank, CASE WHEN score > 0 THEN coalesce(lead(score) OVER o / score, 0) ELSE 0 END AS ratio
  FROM hscore WINDOW o AS (PARTITION BY id ORDER BY score DESC, extra, base DESC, hid)),
dv0 AS (
  SELECT p.id, p.cell_id, r.id IS NULL AS bare, r.factor, r.score AS oscore, k.nn AS n_nodes, k.node_id, h.hid, h.ratio, h.far, h.score AS hscore
  FROM (SELECT * FROM points WHERE id NOT IN (SELECT id FROM bestx)) p LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.id = p.id
  LEFT JOIN (SELECT cell_id, count(*) AS nn, min(node_id) AS node_id FROM bnode_cell GROUP BY 1) k ON k.cell_id = p.cell_id
  LEFT JOIN (SELECT * FROM hrank WHERE rank = 1) h ON h.id = p.id),
dv AS (
  SELECT * FROM (SELECT *, CASE WHEN bare AND n_nodes IS NOT NULL THEN 'node' WHEN hid IS NOT NULL AND (bare OR (factor < 1 AND hscore > 3.0::DOUBLE * oscore)) THEN 'hint' END AS via FROM dv0)
  WHERE via IS NOT NULL),
hstat AS (
  SELECT d.hid, count(*) AS n, max(ratio) AS worst, max(far) AS far, min(coalesce(share, 0)) AS least_share
  FROM dv d LEFT JOIN hp ON hp.hid = d.hid AND hp.cell_id = d.cell_id WHERE via = 'hint' GROUP BY 1),
hout AS (
  SELECT *, far > 100 OR worst >= 0.75 OR (n > 1 AND worst >= 0.25) AS unsure, n > 1 OR least_share < 1 - 0.2::DOUBLE AS review FROM hstat)
"""

SQL = {
    "node_rules": f"""WITH {_CTES}
SELECT id, CASE WHEN n_nodes > 1 THEN 'AMBIGUOUS_BUILDING' WHEN n > 1 THEN 'MULTI_ADDRESS_BUILDING' ELSE 'CLEAN' END AS bucket,
  CASE WHEN n_nodes > 1 THEN 0.3 WHEN n > 1 THEN 0.7 ELSE 0.85 END::DOUBLE AS confidence, CASE WHEN n_nodes = 1 THEN node_id END AS target
FROM (SELECT *, count(*) OVER (PARTITION BY cell_id) AS n FROM dv WHERE via = 'node')""",
    "hint_rules": f"""WITH {_CTES}
SELECT id, CASE WHEN unsure THEN 'AMBIGUOUS_BUILDING' WHEN review THEN 'REVIEW' ELSE 'CLEAN' END AS bucket,
  round(greatest(0, least(CASE WHEN unsure THEN 0.4 WHEN review THEN 0.6 ELSE 0.8 END::DOUBLE, 1 - 0.5::DOUBLE * worst)), 6) AS confidence, hid AS target
FROM dv JOIN hout USING (hid) WHERE via = 'hint'""",
    "hint_preferred": f"WITH {_CTES} SELECT via, count(*) AS n, count(DISTINCT cell_id) AS cells FROM dv GROUP BY via",
    "building_nodes_in_cells": f"WITH {_CTES} SELECT node_id, cell_id FROM bnode_cell",
}
