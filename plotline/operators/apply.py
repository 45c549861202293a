"""Commands that apply proposals: what to tag, where to put address nodes, what to delete.

Proposals:  id, bucket, target_layer (building, node or hint), target, kind, keeps_node,
            and found_key and found_tags of the feature that has the address already
Groups:     id, x, y, tags, dup_ids
Features:   layer, fid and a shape f (see functions.shapes), and fx, fy, where a building
            that is mapped as a node is

An address proposed for a building alone tags the building. Of several, or where the
footprint holds another address, each becomes a node inside it. Hints have no element to
tag, so that an address on one is a node as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.address import blank, fill_tags
from plotline.functions.geometry import box_ring, circle_ring, in_polygon
from plotline.functions.shapes import rings_centroid, with_interior_point, with_rings
from plotline.operators.edits import applicable
from plotline.operators.grid import grid_join, with_box
from plotline.operators.match import GRID
from plotline.operators.placing import STAND_IN, placed_beside, placed_inside
from plotline.spread import stored

#: A node nearer than this to its new place stays where it is.
STAYS = 0.05
LETTERS = {"building": "b", "node": "m", "hint": "h"}


def own_tags(tags: Column, prefixes: tuple[str, ...] = ("addr:",)) -> Column:
    """The tags that are copied to what an address becomes."""

    def copied(k: Column, v: Column) -> Column:
        return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(k, p))

    return F.map_filter(tags, copied)


def target_shapes(buildings: DataFrame, hints: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Features (layer, fid, rings, fx, fy) of buildings (bid, b), hints (hint_id, h) and
    nodes (node_id, mx, my), whose shape is a stand-in circle of 16 corners."""

    def of(df: DataFrame, layer: str, key: str, prefix: str) -> DataFrame:
        rings = F.col(f"{prefix}rings") if f"{prefix}rings" in df.columns else F.array(box_ring(prefix))
        nowhere = F.lit(None).cast("double")
        return df.select(F.lit(layer).alias("layer"), F.col(key).alias("fid"), rings.alias("rings"), nowhere.alias("fx"), nowhere.alias("fy"))

    out = of(buildings, "building", "bid", "b")
    if hints is not None:
        out = out.unionByName(of(hints, "hint", "hint_id", "h"))
    if nodes is not None:
        circle = circle_ring(F.col("mx"), F.col("my"), STAND_IN, 16)
        out = out.unionByName(nodes.select(F.lit("node").alias("layer"), F.col("node_id").alias("fid"), F.array(circle).alias("rings"), F.col("mx").alias("fx"), F.col("my").alias("fy")))
    return out


def steps(proposals: DataFrame, groups: DataFrame, live: DataFrame | None = None, picks: DataFrame | None = None) -> DataFrame:
    """Addresses of proposals that can be applied: proposal, alone and action, which is
    known (already there), fill (add what is lacking), copy (as it is), tag (if it need not
    stay a node) or place.

    ``picks`` (id, layer, fid) are buildings chosen instead of the proposals' own; one
    that leaves the choice open is not applied without one. ``live`` (node_id) are the
    source nodes that still exist: an address whose node is gone has been dealt with.
    Proposals for one building are one, named by its least address, gone or not.
    """
    rows = proposals.where(applicable(F.col("bucket"), F.col("kind")))
    rows = rows.join(groups.select(F.col("id").alias("_g"), "x", "y", "tags", "dup_ids"), F.col("id") == F.col("_g")).drop("_g")
    if picks is None:
        rows = rows.withColumns({"layer": F.col("target_layer"), "fid": F.col("target"), "_picked": F.lit(False)})
    else:
        chosen = picks.select(F.col("id").alias("_p"), F.col("layer").alias("_layer"), F.col("fid").alias("_fid"))
        rows = rows.join(chosen, F.col("id") == F.col("_p"), "left")
        other = F.col("_fid").isNotNull() & ~(F.col("_fid").eqNullSafe(F.col("target")) & F.col("_layer").eqNullSafe(F.col("target_layer")))
        rows = rows.withColumns({"layer": F.coalesce("_layer", "target_layer"), "fid": F.coalesce("_fid", "target"), "_picked": other})
    assigned = F.col("kind").isNull() & F.col("target").isNotNull()
    shared = F.when(assigned, F.struct("target_layer", "target"))
    per = rows.where(assigned).groupBy(F.struct("target_layer", "target").alias("_of")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_least"))
    rows = rows.join(per, shared == F.col("_of"), "left")
    rows = rows.withColumns({"proposal": F.coalesce("_least", "id"), "alone": F.coalesce("_n", F.lit(1)) == 1})
    if live is not None:
        rows = rows.join(live.select(F.col("node_id").alias("_l")), F.col("id") == F.col("_l"), "left_semi")
    unit = ~blank(F.try_element_at("tags", F.lit("addr:unit")))
    stays = F.coalesce("keeps_node", F.lit(False)) & (~F.col("_picked") | unit)
    filled = ((F.col("bucket") == "CLEAN") & (F.col("kind") == "IDENTICAL")) | (F.col("bucket") == "FILL_EXISTING")
    action = (
        F.when(F.col("bucket") == "EXISTING_ADDRESS", "known")
        .when(filled & F.col("found_key").isNotNull(), "fill")
        .when(F.col("bucket") == "NO_BUILDING", "copy")
        .when(F.col("fid").isNotNull(), F.when(F.col("alone") & (F.col("layer") != "hint") & ~stays, "tag").otherwise("place"))
    )
    return rows.withColumn("action", action).where("action IS NOT NULL").select("proposal", "id", "x", "y", "tags", "dup_ids", "layer", "fid", "alone", "action", "found_key", "found_tags")


def shared_footprints(rows: DataFrame, features: DataFrame, here: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """Ids of the rows (id, dup_ids, layer, fid) whose footprint holds, strictly inside, an
    address node (node_id, hx, hy, source) of the edited layer that is not their own. A node
    on the building's outline (layer, fid, node_id) belongs to the building's own address."""
    shapes = with_rings(features.select(F.col("layer").alias("_layer"), F.col("fid").alias("_fid"), F.col("rings").alias("_rings")), F.col("_rings"), "s").drop("_rings", "sedges")
    mine = rows.select("id", "dup_ids", "layer", "fid").join(shapes, (F.col("layer") == F.col("_layer")) & (F.col("fid") == F.col("_fid"))).drop("_layer", "_fid")
    points = with_box(here.select("node_id", "hx", "hy", "source"), "q", "hx", "hy")
    own = F.col("source") & F.array_contains(F.concat(F.array("id"), "dup_ids"), F.col("node_id"))
    hits = grid_join(mine, points, "s", "q", GRID, in_polygon(F.col("hx"), F.col("hy"), F.col("srings"), strict=True) & ~own).select("id", "layer", "fid", "node_id")
    if outline is not None:
        hits = hits.join(outline.select("layer", "fid", "node_id"), ["layer", "fid", "node_id"], "left_anti")
    return hits.select("id").distinct()


def places(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Where the rows (id, x, y, layer, fid, alone) go: beside a building's node, in the
    middle of a hint that stands for one address, else inside the footprint."""
    wanted = rows.select(F.col("layer").alias("_layer"), F.col("fid").alias("_fid")).distinct()
    shapes = features.join(wanted, (F.col("layer") == F.col("_layer")) & (F.col("fid") == F.col("_fid")), "left_semi")
    shapes = with_interior_point(shapes, "rings", "_inner").withColumn("_centre", rings_centroid(F.col("rings")))
    shapes = stored(shapes.select(F.struct("layer", "fid").alias("key"), "rings", "fx", "fy", "_inner", "_centre"), "targets")
    rows = rows.withColumn("_k", F.struct("layer", "fid")).select("id", "x", "y", "_k", (F.col("alone") & (F.col("layer") == "hint")).alias("_middle"))
    joined = rows.join(shapes, F.col("_k") == F.col("key")).drop("_k")
    centred = in_polygon(F.col("_centre.x"), F.col("_centre.y"), F.col("rings"), strict=True)
    point = F.when(centred, F.col("_centre")).otherwise(F.col("_inner"))
    middle = joined.where("_middle").select("id", point["x"].alias("px"), point["y"].alias("py"))
    beside = placed_beside(joined.where("fx IS NOT NULL").withColumns({"mx": F.col("fx"), "my": F.col("fy")}), "key").select("id", "px", "py")
    inside = joined.where("fx IS NULL AND NOT _middle").withColumns({"ix": F.col("_inner.x"), "iy": F.col("_inner.y")})
    return middle.unionByName(beside).unionByName(placed_inside(inside, "key").select("id", "px", "py"))


def commands(
    proposals: DataFrame, groups: DataFrame, features: DataFrame, here: DataFrame | None = None, outline: DataFrame | None = None,
    live: DataFrame | None = None, picks: DataFrame | None = None, same_layer: bool = False, delete_sources: bool = True,
) -> DataFrame:
    """One row a command: proposal, step, layer, op, pkey, tags, x, y.

    Set tags on what has the address or is to have it, add a node (with its place), or,
    if addresses and buildings are in the ``same_layer``, move the address's own; then
    delete the source nodes that are no longer needed and still exist. ``here`` are the
    address nodes now in the edited layer; see ``shared_footprints`` and ``steps``.
    """
    rows = stored(steps(proposals, groups, live, picks), "steps")
    if here is not None:
        held = shared_footprints(rows.where("action = 'tag'"), features, here, outline).select(F.col("id").alias("_held"))
        rows = rows.join(held, F.col("id") == F.col("_held"), "left")
        rows = stored(rows.withColumn("action", F.when(F.col("_held").isNotNull(), "place").otherwise(F.col("action"))).drop("_held"), "steps")
    spots = places(rows.where("action = 'place'"), features).select(F.col("id").alias("_s"), "px", "py")
    nowhere, own = F.lit(None).cast("double"), own_tags(F.col("tags"))
    nothing = F.create_map().cast("map<string,string>")
    letter = F.create_map(*[F.lit(v) for pair in LETTERS.items() for v in pair])
    as_node = F.concat(F.lit("n"), F.col("id").cast("string"))

    def of(df: DataFrame, op: str, pkey: Column, tags: Column, x: Column = nowhere, y: Column = nowhere, step: int = 1, layer: str = "target") -> DataFrame:
        return df.select("proposal", F.lit(step).alias("step"), F.lit(layer).alias("layer"), F.lit(op).alias("op"), pkey.alias("pkey"), tags.alias("tags"), x.alias("x"), y.alias("y"))

    lacking = rows.where("action = 'fill'").withColumn("_new", fill_tags(own, F.col("found_tags"))).where(F.size("_new") > 0)
    out = of(lacking, "set_tags", F.col("found_key"), F.col("_new"))
    out = out.unionByName(of(rows.where("action = 'tag'"), "set_tags", F.concat(F.element_at(letter, F.col("layer")), F.col("fid").cast("string")), own))
    moved = rows.where("action = 'place'").join(spots, F.col("id") == F.col("_s"))
    if same_layer:
        far = F.sqrt(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2)) > STAYS
        out = out.unionByName(of(moved.where(far), "move_node", as_node, nothing, F.col("px"), F.col("py")))
    else:
        out = out.unionByName(of(moved, "add_node", as_node, own, F.col("px"), F.col("py")))
        out = out.unionByName(of(rows.where("action = 'copy'"), "add_node", as_node, own, F.col("x"), F.col("y")))
    if delete_sources:
        stays = F.col("action").isin("place", "copy") if same_layer else F.lit(False)
        gone = rows.select("proposal", F.explode(F.when(stays, F.col("dup_ids")).otherwise(F.concat(F.array("id"), "dup_ids"))).alias("id"))
        if live is not None:
            gone = gone.join(live.select(F.col("node_id").alias("_l")), F.col("id") == F.col("_l"), "left_semi")
        out = out.unionByName(of(gone, "delete_node", as_node, nothing, step=2, layer="target" if same_layer else "source"))
    return out


def found_features(proposals: DataFrame, groups: DataFrame, located: DataFrame, buildings: DataFrame) -> DataFrame:
    """``proposals`` with found_key and found_tags: the existing address (eid, e_tags) in the
    group's cell that is most like it, the least id of equals, or else the building's own
    (bid, b_tags)."""
    from plotline.functions.address import compare, kind_rank
    from plotline.operators.match import address_columns

    e = located.withColumnRenamed("cell_id", "_c")
    wanted = proposals.where("kind IS NOT NULL").select(F.col("id").alias("_w"))
    pairs = groups.join(wanted, F.col("id") == F.col("_w"), "left_semi").join(e, (F.col("cell_id") == F.col("_c")) & (F.col("nn") == F.col("e_nn")))
    pairs = pairs.withColumn("_k", compare(address_columns(), address_columns("e_"))).where("_k IS NOT NULL")
    best = pairs.groupBy(F.col("id").alias("_i")).agg(F.min_by(F.struct("eid", "e_tags"), F.struct(kind_rank(F.col("_k")), "eid")).alias("_e"))
    rows = proposals.join(best, F.col("id") == F.col("_i"), "left").join(buildings.select(F.col("bid").alias("_b"), "b_tags"), (F.col("target") == F.col("_b")) & F.col("kind").isNotNull(), "left")
    key = F.coalesce(F.concat(F.lit("e"), F.col("_e.eid").cast("string")), F.concat(F.lit("b"), F.col("_b").cast("string")))
    return rows.select(*proposals.columns, key.alias("found_key"), F.coalesce("_e.e_tags", "b_tags").alias("found_tags"))
