"""Queries of the commands that apply the town's proposals, each with its SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions.address import with_normal
from plotline.operators import apply as P
from plotline.operators import match as M
from plotline.operators.placing import RINGS
from plotline.operators.stand_ins import match_with_stand_ins
from plotline.plans import stand_in_queries as stand_ins
from plotline.plans import sqltext as S
from plotline.plans.match_queries import SETTINGS, Town
from plotline.plans.match_sql import match_ctes
from plotline.plans.text_queries import _tags
from plotline.session import shared_folder
from plotline.spread import stored
from plotline.sinks import layers as L
from plotline.sources.openaddr import read_nodes

ORIGIN = (-112.175, 33.565)


def _proposals(t: Town) -> DataFrame:
    layered = t.final.withColumn("target_layer", F.when(F.col("target").isNotNull(), "building"))
    located = M.existing_in_cells(_tags(t.existing, "e_"), t.cells)
    return stored(P.found_features(layered, t.groups, located, _tags(t.buildings, "b_")), "found")


def _here(t: Town) -> DataFrame:
    return t.existing.select(F.col("eid").alias("node_id"), F.col("ex").alias("hx"), F.col("ey").alias("hy"), F.lit(False).alias("source"))


def _shown(commands: DataFrame) -> DataFrame:
    tags = F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return commands.select("proposal", F.col("step").cast("long").alias("step"), "layer", "op", "pkey", tags.alias("tags"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def edit_commands(spark, sf_dir) -> DataFrame:
    """Commands that bring the town's addresses from a layer of their own to its buildings."""
    t = Town(spark, sf_dir)
    return _shown(P.commands(_proposals(t), _tags(t.groups, ""), P.target_shapes(t.buildings), _here(t)))


def edit_commands_in_place(spark, sf_dir) -> DataFrame:
    """The same where addresses and buildings are one layer, every ninth node being gone."""
    t = Town(spark, sf_dir)
    nodes = t.addresses.where("id % 9 <> 4")
    here = _here(t).unionByName(nodes.select(F.col("id").alias("node_id"), F.col("x").alias("hx"), F.col("y").alias("hy"), F.lit(True).alias("source")))
    return _shown(P.commands(_proposals(t), _tags(t.groups, ""), P.target_shapes(t.buildings), here, live=nodes.select(F.col("id").alias("node_id")), same_layer=True))


def stand_in_commands(spark, sf_dir) -> DataFrame:
    """Commands where the town also has hints and buildings mapped as nodes."""
    t = Town(spark, sf_dir)
    hints, nodes = stand_ins.hints(spark, sf_dir), stand_ins.nodes(spark, sf_dir)
    final = match_with_stand_ins(with_normal(t.addresses), t.cells, t.buildings, t.existing, nodes, hints, SETTINGS)
    located = M.existing_in_cells(_tags(t.existing, "e_"), t.cells)
    found = P.found_features(stored(final, "final"), t.groups, located, _tags(t.buildings, "b_"))
    return _shown(P.commands(found, _tags(t.groups, ""), P.target_shapes(t.buildings, hints, nodes), _here(t)))


def command_counts(spark, sf_dir) -> DataFrame:
    t = Town(spark, sf_dir)
    done = P.commands(_proposals(t), _tags(t.groups, ""), P.target_shapes(t.buildings), _here(t))
    return done.groupBy("layer", "op").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("proposal").alias("proposals"))


def _layer(t: Town) -> DataFrame:
    """The layer that is edited: buildings and existing addresses with their tags."""
    nowhere = F.lit(None).cast("double")
    built = _tags(t.buildings, "b_").select(F.concat(F.lit("b"), F.col("bid").cast("string")).alias("pkey"), F.col("b_tags").alias("tags"), nowhere.alias("x"), nowhere.alias("y"))
    return built.unionByName(_tags(t.existing, "e_").select(F.concat(F.lit("e"), F.col("eid").cast("string")).alias("pkey"), F.col("e_tags").alias("tags"), F.col("ex").alias("x"), F.col("ey").alias("y")))


def _parts(layer: DataFrame) -> DataFrame:
    tag = lambda k: F.try_element_at("tags", F.lit(k)).alias(k.split(":")[1])
    return layer.select("pkey", tag("addr:housenumber"), tag("addr:street"), tag("addr:unit"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def edited_layer(spark, sf_dir) -> DataFrame:
    """Addresses of the edited layer after all commands."""
    t = Town(spark, sf_dir)
    done = stored(P.commands(_proposals(t), _tags(t.groups, ""), P.target_shapes(t.buildings), _here(t)), "commands")
    return _parts(L.edited(_layer(t), done))


def extract_round_trip(spark, sf_dir) -> DataFrame:
    """The nodes of the edited layer, written as an extract in XML and read again."""
    t = Town(spark, sf_dir)
    done = stored(P.commands(_proposals(t), _tags(t.groups, ""), P.target_shapes(t.buildings), _here(t)), "commands")
    nodes = L.edited(_layer(t), done).where("x IS NOT NULL").withColumn("id", F.substring("pkey", 2, 20).cast("long") * 2 + F.startswith("pkey", F.lit("e")).cast("int"))
    path = f"{shared_folder(spark)}/plotline/extract-{uuid4().hex}"
    L.write_nodes(L.with_degrees(nodes, *ORIGIN), path)
    tag = lambda k: F.try_element_at("tags", F.lit(k)).alias(k.split(":")[1])
    return read_nodes(spark, path).select("id", tag("addr:housenumber"), tag("addr:street"), tag("addr:unit"), "lon", "lat")


QUERIES = {f.__name__: f for f in (edit_commands, edit_commands_in_place, stand_in_commands, command_counts, edited_layer, extract_round_trip)}

_ADDR = "'addr:housenumber=' || number || ';addr:street=' || street || coalesce(';addr:unit=' || unit, '')"
_IN_BOX = "{x} > bxmin AND {x} < bxmax AND {y} > bymin AND {y} < bymax"


def _spot(taken: str) -> str:
    """The place of a row of pl, given a list of places taken."""
    clear = lambda at, d: f"len(list_filter({taken}, lambda t: sqrt((t.x - ({at[0]})) ** 2 + (t.y - ({at[1]})) ** 2) < {d}::DOUBLE)) = 0"
    spots = (
        f"list_filter(list_transform(s, lambda o: {{'x': p.mx + o.i * 3.0::DOUBLE, 'y': p.my + o.j * 3.0::DOUBLE}}), "
        f"lambda q: q.x > p.bxmin AND q.x < p.bxmax AND q.y > p.bymin AND q.y < p.bymax AND {clear(('q.x', 'q.y'), 2)})"
    )
    return (
        f"CASE WHEN p.own AND {clear(('p.x', 'p.y'), 0.5)} THEN {{'x': p.x, 'y': p.y}} WHEN {clear(('p.mx', 'p.my'), 2)} THEN {{'x': p.mx, 'y': p.my}} "
        f"ELSE coalesce({spots}[1], {{'x': p.mx, 'y': p.my}}) END"
    )


def _commands_sql(same: bool) -> str:
    live = "id % 9 <> 4" if same else "true"
    others = "EXISTS (SELECT 1 FROM existing e WHERE " + _IN_BOX.format(x="e.ex", y="e.ey") + ")"
    if same:
        others += " OR EXISTS (SELECT 1 FROM located l WHERE l.id % 9 <> 4 AND " + _IN_BOX.format(x="l.x", y="l.y") + " AND NOT (l.exact = t0.exact AND l.cell_id IS NOT DISTINCT FROM t0.cell_id))"
    delete = "l.id % 9 <> 4 AND (l.id <> t.id OR action NOT IN ('place', 'copy'))" if same else "true"
    moves = (
        "SELECT proposal, 1, 'target', 'move_node', 'n' || id, '', spot.x, spot.y FROM placed WHERE sqrt((spot.x - x) ** 2 + (spot.y - y) ** 2) > 0.05::DOUBLE"
        if same
        else f"SELECT proposal, 1, 'target', 'add_node', 'n' || id, {_ADDR}, spot.x, spot.y FROM placed UNION ALL "
        f"SELECT proposal, 1, 'target', 'add_node', 'n' || id, {_ADDR}, x, y FROM done WHERE action = 'copy'"
    )
    return f"""WITH RECURSIVE {match_ctes()},
fe0 AS (
  SELECT p.id, e.eid, e.e_number, e.e_street, e.e_unit, list_position({S.KIND_LIST}, {S.compare("p.", "e.e_")}) AS o
  FROM groups p JOIN cells c USING (cell_id) JOIN ne e ON ex >= cxmin AND ex <= cxmax AND ey >= cymin AND ey <= cymax),
fe AS (SELECT * FROM fe0 WHERE o IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, eid) = 1),
ap AS (
  SELECT f.*, g.x, g.y, g.number, g.street, g.unit, g.exact, g.cell_id, coalesce('e' || fe.eid, CASE WHEN f.kind IS NOT NULL THEN 'b' || b.bid END) AS fkey,
    CASE WHEN fe.eid IS NOT NULL THEN e_number ELSE b_number END AS fnumber, CASE WHEN fe.eid IS NOT NULL THEN e_street ELSE b_street END AS fstreet,
    CASE WHEN fe.eid IS NOT NULL THEN e_unit ELSE b_unit END AS funit, bxmin, bymin, bxmax, bymax
  FROM final f JOIN groups g USING (id) LEFT JOIN fe ON fe.id = f.id AND f.kind IS NOT NULL LEFT JOIN buildings b ON b.bid = f.target
  WHERE bucket IN ('CLEAN', 'FILL_EXISTING', 'MULTI_ADDRESS_BUILDING', 'REVIEW', 'NO_BUILDING', 'AMBIGUOUS_BUILDING') OR (bucket = 'EXISTING_ADDRESS' AND kind = 'IDENTICAL')),
al AS (SELECT *, CASE WHEN kind IS NULL THEN target END AS shared FROM ap),
st AS (
  SELECT *, CASE WHEN shared IS NULL THEN id ELSE min(id) OVER (PARTITION BY shared) END AS proposal, CASE WHEN shared IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY shared) END AS n FROM al),
t0 AS (
  SELECT *, CASE WHEN bucket = 'EXISTING_ADDRESS' THEN 'known' WHEN ((bucket = 'CLEAN' AND kind = 'IDENTICAL') OR bucket = 'FILL_EXISTING') AND fkey IS NOT NULL THEN 'fill'
    WHEN bucket = 'NO_BUILDING' THEN 'copy' WHEN target IS NOT NULL THEN CASE WHEN n = 1 AND NOT keeps_node THEN 'tag' ELSE 'place' END END AS first FROM st WHERE {live}),
done AS (SELECT *, CASE WHEN first = 'tag' AND ({others}) THEN 'place' ELSE first END AS action FROM t0 WHERE first IS NOT NULL),
pl AS (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS k, (bxmin + bxmax) / 2 AS mx, (bymin + bymax) / 2 AS my, {_IN_BOX.format(x='x', y='y')} AS own
  FROM done WHERE action = 'place'),
sp AS (
  SELECT list({{'i': i, 'j': j}} ORDER BY r, i, j) AS s FROM range(1, {RINGS + 1}) a(r), range(-{RINGS}, {RINGS + 1}) b(i), range(-{RINGS}, {RINGS + 1}) c(j) WHERE greatest(abs(i), abs(j)) = r),
rec AS (
  SELECT p.id, p.target, p.k, CASE WHEN p.own THEN {{'x': p.x, 'y': p.y}} ELSE {{'x': p.mx, 'y': p.my}} END AS spot,
    [CASE WHEN p.own THEN {{'x': p.x, 'y': p.y}} ELSE {{'x': p.mx, 'y': p.my}} END] AS taken FROM pl p WHERE p.k = 1
  UNION ALL
  SELECT id, target, k, spot, list_append(taken, spot) FROM (
    SELECT p.id, p.target, p.k, rec.taken, {_spot('rec.taken')} AS spot FROM rec JOIN pl p ON p.target = rec.target AND p.k = rec.k + 1, sp)),
placed AS (SELECT d.*, rec.spot FROM done d JOIN rec USING (id)),
lacking AS (SELECT proposal, fkey, array_to_string(list_filter([CASE WHEN fnumber IS NULL THEN 'addr:housenumber=' || number END, CASE WHEN fstreet IS NULL THEN 'addr:street=' || street END,
  CASE WHEN funit IS NULL THEN 'addr:unit=' || unit END], lambda v: v IS NOT NULL), ';') AS tags FROM done WHERE action = 'fill'),
commands AS (
  SELECT proposal, 1::BIGINT AS step, 'target' AS layer, 'set_tags' AS op, fkey AS pkey, tags, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM lacking WHERE tags <> '' UNION ALL
  SELECT proposal, 1, 'target', 'set_tags', 'b' || target, {_ADDR}, NULL, NULL FROM done WHERE action = 'tag' UNION ALL
  {moves} UNION ALL
  SELECT t.proposal, 2, '{"target" if same else "source"}', 'delete_node', 'n' || l.id, '', NULL, NULL FROM done t JOIN located l ON l.exact = t.exact AND l.cell_id IS NOT DISTINCT FROM t.cell_id WHERE {delete})
"""


_ROWS = "SELECT proposal, step, layer, op, pkey, tags, round(x, 6) AS x, round(y, 6) AS y FROM commands"
_EDITED = """,
had AS (SELECT 'b' || bid AS pkey, b_number AS housenumber, b_street AS street, b_unit AS unit, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM buildings UNION ALL
  SELECT 'e' || eid, e_number, e_street, e_unit, ex, ey FROM existing),
parsed AS (SELECT *, nullif(regexp_extract(tags, 'addr:housenumber=([^;]*)', 1), '') AS n1, nullif(regexp_extract(tags, 'addr:street=([^;]*)', 1), '') AS s1,
  nullif(regexp_extract(tags, 'addr:unit=([^;]*)', 1), '') AS u1 FROM commands),
sets AS (SELECT pkey, arg_max(n1, {'p': proposal, 'v': n1}) FILTER (n1 IS NOT NULL) AS n1, arg_max(s1, {'p': proposal, 'v': s1}) FILTER (s1 IS NOT NULL) AS s1, arg_max(u1, {'p': proposal, 'v': u1}) FILTER (u1 IS NOT NULL) AS u1
  FROM parsed WHERE op = 'set_tags' GROUP BY pkey),
edited AS (SELECT h.pkey, coalesce(n1, housenumber) AS housenumber, coalesce(s1, street) AS street, coalesce(u1, unit) AS unit, x, y FROM had h LEFT JOIN sets USING (pkey) UNION ALL
  SELECT pkey, n1, s1, u1, x, y FROM parsed WHERE op = 'add_node')
"""
SQL = {
    "edited_layer": _commands_sql(False) + _EDITED + "SELECT pkey, housenumber, street, unit, round(x, 6) AS x, round(y, 6) AS y FROM edited",
    "extract_round_trip": _commands_sql(False) + _EDITED + f"""SELECT substr(pkey, 2)::BIGINT * 2 + (pkey LIKE 'e%')::INT AS id, housenumber, street, unit,
        round({ORIGIN[0]}::DOUBLE + x / (111320.0::DOUBLE * cos(radians({ORIGIN[1]}::DOUBLE))), 7) AS lon, round({ORIGIN[1]}::DOUBLE + y / 110540.0::DOUBLE, 7) AS lat FROM edited WHERE x IS NOT NULL""",
    "edit_commands": _commands_sql(False) + _ROWS,
    "edit_commands_in_place": _commands_sql(True) + _ROWS,
    "command_counts": _commands_sql(False) + "SELECT layer, op, count(*) AS n, count(DISTINCT proposal) AS proposals FROM commands GROUP BY layer, op",
}
