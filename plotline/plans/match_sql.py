"""The match in SQL, step by step as CTEs."""

from __future__ import annotations

from plotline.plans import sqltext as S
from plotline.plans.town import town_sql

DIST = "sqrt(greatest(cxmin - x, 0, x - cxmax) ** 2 + greatest(cymin - y, 0, y - cymax) ** 2)"
BDIST = "sqrt(greatest(bxmin - x, 0, x - bxmax) ** 2 + greatest(bymin - y, 0, y - bymax) ** 2)"
INSIDE = "x > bxmin AND x < bxmax AND y > bymin AND y < bymax"


def match_ctes(distance: float = 4.0, extra: float = 200.0) -> str:
    return f"""
{town_sql()},
near AS (
  SELECT id, cell_id, {DIST} AS d, (cxmax - cxmin) * (cymax - cymin) AS area
  FROM addresses JOIN cells ON cxmin <= x + {distance} AND cxmax >= x - {distance} AND cymin <= y + {distance} AND cymax >= y - {distance}),
best AS (
  SELECT id, cell_id, d FROM near WHERE d <= {distance}
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY d > 0, CASE WHEN d > 0 THEN d ELSE area END, cell_id) = 1),
located AS (SELECT a.*, b.cell_id, coalesce(b.d > 0, false) AS snapped, coalesce(b.d, 0) AS cell_distance FROM addresses a LEFT JOIN best b USING (id)),
groups0 AS (SELECT exact, coalesce(cell_id, '<none>') AS c, min(id) AS id, count(*) - 1 AS dups FROM located GROUP BY 1, 2),
groups1 AS (SELECT l.*, g.dups, count(*) OVER (PARTITION BY g.exact) > 1 AS cross_dup FROM groups0 g JOIN located l USING (id)),
{S.normal("groups1", "groups")},
{S.normal("buildings", "nb", "b_")},
{S.normal("existing", "ne", "e_")},
pairs0 AS (
  SELECT bid, cell_id, factor, (bxmax - bxmin) * (bymax - bymin) AS area,
    greatest(0, least(bxmax, cxmax) - greatest(bxmin, cxmin)) * greatest(0, least(bymax, cymax) - greatest(bymin, cymin)) AS area_in
  FROM buildings JOIN cells ON bxmin <= cxmax AND cxmin <= bxmax AND bymin <= cymax AND cymin <= bymax),
pairs1 AS (SELECT *, area_in / area AS share FROM pairs0 WHERE area_in > 0),
homes AS (
  SELECT bid, cell_id AS home FROM pairs1 WHERE share >= 1 - 0.2::DOUBLE AND cell_id IN (SELECT cell_id FROM groups WHERE cell_id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY bid ORDER BY share DESC, cell_id) = 1),
pairs AS (
  SELECT p.*, area_in * factor AS cell_score FROM pairs1 p LEFT JOIN homes USING (bid)
  WHERE (home IS NULL OR home = cell_id) AND (share >= 0.1::DOUBLE OR area_in >= 20)),
points AS (SELECT * FROM groups WHERE cell_id IS NOT NULL AND NOT cross_dup),
holds AS (SELECT id, bid FROM points JOIN buildings ON {INSIDE}),
cand0 AS (SELECT id, bid, cell_score FROM points JOIN pairs USING (cell_id)),
cand AS (SELECT id, bid, cell_score, holds.id IS NOT NULL AS hold FROM cand0 FULL JOIN holds USING (id, bid)),
det AS (
  SELECT c.id, c.bid, hold, factor, x, y, cell_score IS NULL AS extra, coalesce(cell_score, (bxmax - bxmin) * (bymax - bymin) * factor) AS base,
    coalesce(building IN ('yes', 'true', '1'), true) AS generic, b_exact IS NOT NULL AS has, {BDIST} AS far, {S.compare("p.", "b.b_").replace("p.", "p.").replace("b.b_", "b.b_")} AS kind
  FROM cand c JOIN points p ON p.id = c.id JOIN nb b ON b.bid = c.bid),
ex AS (SELECT *, bool_or(factor >= 1 AND NOT generic) OVER (PARTITION BY id) AS explicit FROM det),
s1 AS (SELECT *, CASE WHEN explicit AND NOT hold AND generic AND factor >= 1 THEN base * 0.3::DOUBLE ELSE base END AS a1 FROM ex),
s2 AS (SELECT *, CASE WHEN hold AND factor >= 1 THEN a1 * 4.0::DOUBLE ELSE a1 END AS a2 FROM s1),
s3 AS (SELECT *, CASE WHEN has AND kind IS NULL THEN a2 * 0.2::DOUBLE ELSE a2 END AS score FROM s2),
ranked AS (
  SELECT *, row_number() OVER o AS rank, CASE WHEN score > 0 THEN coalesce(lead(score) OVER o / score, 0) ELSE 0 END AS ratio
  FROM s3 WINDOW o AS (PARTITION BY id ORDER BY score DESC, extra, base DESC, bid)),
found AS (
  SELECT g.id, list_position({S.KIND_LIST}, k) AS o, k FROM (
    SELECT p.id, {S.compare("p.", "e.e_")} AS k
    FROM groups p JOIN cells c USING (cell_id) JOIN ne e ON ex >= cxmin AND ex <= cxmax AND ey >= cymin AND ey <= cymax) g WHERE k IS NOT NULL),
bestx AS (SELECT id, arg_min(k, o) AS ek, count(*) AS ne FROM found GROUP BY id),
lad AS (
  SELECT g.*, r.bid, r.ratio, r.kind, r.has, r.far, ek, ne,
    CASE WHEN g.cell_id IS NULL THEN 'OUTSIDE_CELLS' WHEN cross_dup THEN 'DUPLICATE'
      WHEN ek IN ('IDENTICAL', 'PARTIAL') AND ne = 1 THEN CASE WHEN ek = 'PARTIAL' THEN 'FILL_EXISTING' ELSE 'CLEAN' END
      WHEN ek IS NOT NULL THEN 'EXISTING_ADDRESS' WHEN r.bid IS NULL THEN 'NO_BUILDING'
      WHEN has AND kind IN ('IDENTICAL', 'PARTIAL') THEN CASE WHEN kind = 'PARTIAL' THEN 'FILL_EXISTING' ELSE 'CLEAN' END
      WHEN has THEN 'EXISTING_ADDRESS' END AS fixed,
    CASE WHEN ek IS NOT NULL THEN ek WHEN has THEN coalesce(kind, 'OTHER_ADDRESS_ON_BUILDING') END AS fk
  FROM groups g LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (id) LEFT JOIN bestx USING (id)),
decided AS (
  SELECT id, fixed AS bucket,
    CASE fixed WHEN 'OUTSIDE_CELLS' THEN 0.0 WHEN 'DUPLICATE' THEN 0.2 WHEN 'NO_BUILDING' THEN 0.9 ELSE
      CASE fk WHEN 'IDENTICAL' THEN 0.95 WHEN 'PARTIAL' THEN 0.85 WHEN 'STREET_VARIANT' THEN 0.7 WHEN 'UNIT_DIFF' THEN 0.5 WHEN 'STREET_DIFF' THEN 0.3 ELSE 0.2 END END::DOUBLE AS confidence,
    CASE WHEN fixed IN ('CLEAN', 'FILL_EXISTING', 'EXISTING_ADDRESS') AND ek IS NULL THEN bid END AS target, 0.0::DOUBLE AS ratio,
    CASE WHEN fixed NOT IN ('OUTSIDE_CELLS', 'DUPLICATE', 'NO_BUILDING') THEN fk END AS kind
  FROM lad WHERE fixed IS NOT NULL),
opens AS (SELECT l.id, l.bid, l.cell_id, l.ratio, l.snapped, l.far, coalesce(p.share, 0) AS share FROM lad l LEFT JOIN pairs p ON p.bid = l.bid AND p.cell_id = l.cell_id WHERE fixed IS NULL),
per0 AS (
  SELECT bid, count(*) AS n, count(DISTINCT cell_id) AS nc, max(ratio) AS worst, bool_or(snapped) AS sn, max(far) AS far, min(share) AS ls FROM opens GROUP BY bid),
per1 AS (
  SELECT *, CASE WHEN nc > 1 THEN 'REVIEW' WHEN worst >= 0.75 THEN 'AMBIGUOUS_BUILDING' WHEN n > 1 AND worst >= 0.25 THEN 'AMBIGUOUS_BUILDING' WHEN n > 1 THEN 'MULTI_ADDRESS_BUILDING' ELSE 'CLEAN' END AS b1,
    least(1 - 0.5::DOUBLE * worst - CASE WHEN sn THEN 0.1::DOUBLE ELSE 0 END,
      CASE WHEN nc > 1 THEN 0.6 WHEN worst >= 0.75 THEN 0.5 WHEN n > 1 AND worst >= 0.25 THEN 0.4 WHEN n > 1 THEN 0.85 ELSE 1.0 END::DOUBLE) AS c1
  FROM per0),
per2 AS (
  SELECT *, CASE WHEN far > 100 AND b1 IN ('CLEAN', 'MULTI_ADDRESS_BUILDING') THEN 'AMBIGUOUS_BUILDING' ELSE b1 END AS b2, CASE WHEN far > 100 THEN least(c1, 0.4) ELSE c1 END AS c2 FROM per1),
per AS (
  SELECT bid, CASE WHEN b2 IN ('CLEAN', 'MULTI_ADDRESS_BUILDING') AND ls < 1 - 0.2::DOUBLE THEN 'REVIEW' ELSE b2 END AS bucket,
    greatest(0, least(1, CASE WHEN b2 IN ('CLEAN', 'MULTI_ADDRESS_BUILDING') AND ls < 1 - 0.2::DOUBLE THEN least(c2, 0.6) ELSE c2 END)) AS confidence
  FROM per2),
proposals AS (
  SELECT id, bucket, confidence, target, ratio, kind FROM decided UNION ALL
  SELECT o.id, per.bucket, per.confidence, o.bid, o.ratio, NULL FROM opens o JOIN per USING (bid)),
pr AS (
  SELECT p.*, g.x, g.y, g.unit, g.nn || '|' || g.ns AS plain, count(*) OVER (PARTITION BY target) AS on_b FROM proposals p JOIN groups g USING (id)),
pr1 AS (SELECT *, target IS NOT NULL AND on_b = 1 AND kind IS NULL AND bucket IN ('CLEAN', 'REVIEW', 'AMBIGUOUS_BUILDING') AS one, coalesce(trim(unit), '') <> '' AS hu FROM pr),
units AS (SELECT plain, count(DISTINCT target) AS ub FROM pr1 WHERE hu AND target IS NOT NULL GROUP BY plain),
mine AS (SELECT id AS mid, target AS mb, bxmin, bymin, bxmax, bymax FROM pr1 JOIN buildings ON bid = target WHERE one),
hits AS (
  SELECT DISTINCT mid FROM mine JOIN pr1 ON {INSIDE} AND id <> mid AND (target IS NULL OR target = mb) UNION
  SELECT mid FROM mine JOIN existing ON ex > bxmin AND ex < bxmax AND ey > bymin AND ey < bymax),
final AS (
  SELECT id, CASE WHEN one AND hu AND coalesce(ub, 0) <= 1 AND bucket = 'CLEAN' THEN 'REVIEW' WHEN one AND mid IS NOT NULL AND bucket = 'CLEAN' THEN 'MULTI_ADDRESS_BUILDING' ELSE bucket END AS bucket,
    confidence, target, ratio, kind, one AND ((hu AND coalesce(ub, 0) <= 1) OR mid IS NOT NULL) AS keeps_node
  FROM pr1 LEFT JOIN units USING (plain) LEFT JOIN hits ON mid = id)
"""


def select(columns: str, source: str) -> str:
    return f"WITH {match_ctes()} SELECT {columns} FROM {source}"
