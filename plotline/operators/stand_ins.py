"""Addresses without a fitting outline: buildings mapped as nodes, and hints, which are
footprints of a second layer.

Nodes:  node_id, mx, my
Hints:  hint_id, factor and a shape h (see functions.shapes)

A group that no rule about existing addresses decides goes to its cell's building nodes
if the cell offers no outline, or else to its best hint if there is no outline or only an
outbuilding that the hint outweighs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions import address as A
from plotline.functions.shapes import BOX, SHAPE, in_shape, shape_distance
from plotline.operators import match as M
from plotline.operators.grid import grid_join, with_box
from plotline.operators.settings import MatchSettings
from plotline.spread import stored

NODE, HINT = "node", "hint"


def nodes_in_cells(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """Building nodes with every cell that holds them, edges included."""
    points = with_box(nodes.select("node_id", "mx", "my"), "m", "mx", "my")
    return grid_join(points, cells, "m", "c", M.GRID, in_shape(cells, "c", F.col("mx"), F.col("my"))).select("node_id", "cell_id")


def as_buildings(hints: DataFrame) -> DataFrame:
    """Hints in the columns of buildings: without a kind and without an address."""
    rows = hints.select(F.col("hint_id").alias("bid"), "factor", *[F.col(f"h{c}").alias(f"b{c}") for c in BOX + SHAPE if f"h{c}" in hints.columns])
    nothing = F.lit(None).cast("string")
    return A.with_normal(rows.withColumns({c: nothing for c in ("building", "b_number", "b_street", "b_unit", "b_place", "b_exact")}), "b_")


def diverted(
    groups: DataFrame, ranked: DataFrame, existing: DataFrame | None, cell_nodes: DataFrame | None, ranked_hints: DataFrame | None, settings: MatchSettings
) -> DataFrame:
    """Rows id, cell_id, via (node or hint), n_nodes, node_id, hint_id, ratio and far of the
    groups that go to a node or a hint. Nodes come before hints."""
    rows = groups.where(F.col("cell_id").isNotNull() & ~F.col("cross_dup")).select("id", "cell_id")
    if existing is not None:
        rows = rows.join(existing.select(F.col("id").alias("_x")), F.col("id") == F.col("_x"), "left_anti")
    top = ranked.where("rank = 1").select(F.col("id").alias("_t"), F.col("factor").alias("_factor"), F.col("score").alias("_score"))
    rows = rows.join(top, F.col("id") == F.col("_t"), "left")
    if cell_nodes is None:
        rows = rows.withColumns({"n_nodes": F.lit(None).cast("long"), "node_id": F.lit(None).cast("long")})
    else:
        per = cell_nodes.groupBy(F.col("cell_id").alias("_c")).agg(F.count(F.lit(1)).alias("n_nodes"), F.min("node_id").alias("node_id"))
        rows = rows.join(per, F.col("cell_id") == F.col("_c"), "left")
    if ranked_hints is None:
        rows = rows.withColumns({"hint_id": F.lit(None).cast("long"), "ratio": F.lit(0.0), "far": F.lit(0.0), "_hint_score": F.lit(0.0)})
    else:
        best = ranked_hints.where("rank = 1").select(
            F.col("id").alias("_h"), F.col("bid").alias("hint_id"), "ratio", shape_distance(ranked_hints, "b", F.col("x"), F.col("y")).alias("far"), F.col("score").alias("_hint_score")
        )
        rows = rows.join(best, F.col("id") == F.col("_h"), "left")
    none = F.col("_t").isNull()
    outweighed = (F.col("_factor") < 1) & (F.col("_hint_score") > settings.hint_over_outbuilding * F.col("_score"))
    via = F.when(none & F.col("n_nodes").isNotNull(), NODE).when(F.col("hint_id").isNotNull() & (none | outweighed), HINT)
    return rows.withColumn("via", via).where("via IS NOT NULL").select("id", "cell_id", "via", "n_nodes", "node_id", "hint_id", "ratio", "far")


def node_proposals(rows: DataFrame) -> DataFrame:
    """One node in the cell takes the cell's addresses; of several one has to be picked."""
    rows = rows.where(F.col("via") == NODE)
    per = rows.groupBy(F.col("cell_id").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(per, F.col("cell_id") == F.col("_c"))
    one, alone = F.col("n_nodes") == 1, F.col("_n") == 1
    return rows.select(
        "id",
        F.when(one & alone, "CLEAN").when(one, "MULTI_ADDRESS_BUILDING").otherwise("AMBIGUOUS_BUILDING").alias("bucket"),
        F.when(one & alone, 0.85).when(one, 0.7).otherwise(0.3).alias("confidence"),
        F.lit(NODE).alias("target_layer"), F.when(one, F.col("node_id")).alias("target"), F.lit(0.0).alias("ratio"),
    )


def hint_proposals(rows: DataFrame, hint_cells: DataFrame, settings: MatchSettings) -> DataFrame:
    """Rules about a hint see all groups that go to it. A hint is never sure."""
    rows = rows.where(F.col("via") == HINT)
    shares = hint_cells.select(F.col("bid").alias("_b"), F.col("cell_id").alias("_c"), "share")
    rows = rows.join(shares, (F.col("hint_id") == F.col("_b")) & (F.col("cell_id") == F.col("_c")), "left")
    per = rows.groupBy(F.col("hint_id").alias("_hint")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ratio").alias("worst"), F.max("far").alias("most_far"), F.min(F.coalesce("share", F.lit(0.0))).alias("least")
    )
    unsure = (F.col("worst") >= settings.ambiguity_ratio) | ((F.col("n") > 1) & (F.col("worst") >= settings.multi_ambiguity_ratio))
    far = F.col("most_far") > settings.far_match
    review = (F.col("n") > 1) | (F.col("least") < 1 - settings.split_tolerance)
    bucket = F.when(far | unsure, "AMBIGUOUS_BUILDING").when(review, "REVIEW").otherwise("CLEAN")
    most = F.when(far | unsure, 0.4).when(review, 0.6).otherwise(0.8)
    # a far hint that would have been for review keeps the lower of both bounds, which is 0.4
    per = per.select("_hint", bucket.alias("bucket"), F.greatest(F.lit(0.0), F.least(most, 1 - 0.5 * F.col("worst"))).alias("confidence"))
    return rows.join(per, F.col("hint_id") == F.col("_hint")).select("id", "bucket", "confidence", F.lit(HINT).alias("target_layer"), F.col("hint_id").alias("target"), "ratio")


def match_with_stand_ins(
    addresses: DataFrame,
    cells: DataFrame,
    buildings: DataFrame,
    existing: DataFrame | None = None,
    nodes: DataFrame | None = None,
    hints: DataFrame | None = None,
    settings: MatchSettings | None = None,
) -> DataFrame:
    """The whole match over parcels with nodes and hints: id, bucket, confidence,
    target_layer (building, node or hint), target, ratio, kind and keeps_node.

    Addresses on a node or hint still count as other addresses in a building's footprint;
    whether they keep their own node is decided for buildings only.
    """
    settings = settings or MatchSettings()
    groups = stored(M.group_addresses(M.assign_cells(addresses, cells, settings)), "groups")
    addressed = groups.where("cell_id IS NOT NULL")
    pairs = stored(M.building_cells(buildings, cells, addressed, settings), "pairs")
    ranked = stored(M.rank_buildings(groups, pairs, buildings, settings), "ranked")
    matches = stored(M.best_existing(groups, M.existing_in_cells(existing, cells)), "matches") if existing is not None else None
    hint_cells = ranked_hints = None
    if hints is not None:
        outlines = as_buildings(hints)
        hint_cells = stored(M.building_cells(outlines, cells, addressed, settings), "hint-pairs")
        ranked_hints = M.rank_buildings(groups, hint_cells, outlines, settings)
    rows = stored(diverted(groups, ranked, matches, nodes_in_cells(nodes, cells) if nodes is not None else None, ranked_hints, settings), "diverted")
    gone = rows.select(F.col("id").alias("_gone"))
    own = groups.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    own_ranked = ranked.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    stood = node_proposals(rows)
    if hint_cells is not None:
        stood = stood.unionByName(hint_proposals(rows, hint_cells, settings))
    stood = stored(stood, "stand-ins")
    proposals = M.bucket_addresses(own, own_ranked, pairs, matches, settings)
    elsewhere = stood.select("id", "bucket", "confidence", F.lit(None).cast("long").alias("target"), "ratio", F.lit(None).cast("string").alias("kind"))
    both = stored(proposals.unionByName(elsewhere), "proposals")
    final = M.shared_building_pass(both, groups, buildings, existing)
    placed = stood.select(F.col("id").alias("_s"), F.col("target_layer").alias("_layer"), F.col("target").alias("_target"))
    final = final.join(placed, F.col("id") == F.col("_s"), "left")
    layer = F.when(F.col("_s").isNotNull(), F.col("_layer")).when(F.col("target").isNotNull(), "building")
    return final.select("id", "bucket", "confidence", layer.alias("target_layer"), F.coalesce("_target", "target").alias("target"), "ratio", "kind", "keeps_node")
