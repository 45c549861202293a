"""Edits that apply proposals, and what is known of them afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.address import fill_tags

ALWAYS = ("CLEAN", "FILL_EXISTING", "MULTI_ADDRESS_BUILDING", "REVIEW", "NO_BUILDING", "AMBIGUOUS_BUILDING")


def applicable(bucket: Column, kind: Column) -> Column:
    """Whether a proposal can be applied at all."""
    return bucket.isin(*ALWAYS) | ((bucket == "EXISTING_ADDRESS") & F.coalesce(kind == "IDENTICAL", F.lit(False)))


def edits(proposals: DataFrame, groups: DataFrame, delete_sources: bool = True) -> DataFrame:
    """One row per command: id (the proposal), step, layer, op, pkey and tags.

    Proposals have id, bucket, target, kind and keeps_node; groups have id, x, y, tags,
    target_tags and dup_ids. A proposal's commands come in the order of its steps; the
    deletions of its source nodes come last, and only if wanted.
    """
    rows = proposals.join(groups.select(F.col("id").alias("_g"), "x", "y", "tags", "target_tags", "dup_ids"), F.col("id") == F.col("_g"))
    rows = rows.where(applicable(F.col("bucket"), F.col("kind"))).where(~((F.col("bucket") == "AMBIGUOUS_BUILDING") & F.col("target").isNull()))
    building = F.concat(F.lit("b"), F.col("target").cast("string"))
    own = F.map_filter("tags", lambda k, v: F.startswith(k, F.lit("addr:")))
    fill = rows.where(((F.col("bucket") == "FILL_EXISTING") | ((F.col("bucket") == "CLEAN") & F.col("kind").isNotNull())) & F.col("target").isNotNull())
    fill = fill.withColumn("new", fill_tags(F.col("tags"), F.col("target_tags"))).where(F.size("new") > 0)
    parts = [fill.select("id", F.lit(1).alias("step"), F.lit("target").alias("layer"), F.lit("set_tags").alias("op"), building.alias("pkey"), F.col("new").alias("tags"))]
    open_rows = rows.where("kind IS NULL")
    on_building = (F.col("bucket").isin("CLEAN", "REVIEW", "AMBIGUOUS_BUILDING")) & ~F.coalesce("keeps_node", F.lit(False))
    parts.append(open_rows.where(on_building).select("id", F.lit(1).alias("step"), F.lit("target").alias("layer"), F.lit("set_tags").alias("op"), building.alias("pkey"), own.alias("tags")))
    as_node = (F.col("bucket") == "NO_BUILDING") | (F.col("bucket") == "MULTI_ADDRESS_BUILDING") | F.coalesce("keeps_node", F.lit(False))
    place = F.concat(F.lit("n"), F.col("id").cast("string"))
    parts.append(open_rows.where(as_node).select("id", F.lit(1).alias("step"), F.lit("target").alias("layer"), F.lit("add_node").alias("op"), place.alias("pkey"), own.alias("tags")))
    if delete_sources:
        nodes = rows.withColumn("_node", F.explode(F.concat(F.array("id"), "dup_ids")))
        parts.append(nodes.select("id", F.lit(2).alias("step"), F.lit("source").alias("layer"), F.lit("delete_node").alias("op"), F.concat(F.lit("n"), F.col("_node").cast("string")).alias("pkey"), F.create_map().cast("map<string,string>").alias("tags")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def applied_states(log: DataFrame) -> DataFrame:
    """State changes from a log of commands (proposal, seq, delta +1 applied or redone, -1 undone).

    A proposal is in effect while any of its commands is. Rows are emitted where it comes
    into effect (redone) or goes out of effect (undone). An undo of nothing is ignored.
    """
    order = Window.partitionBy("proposal").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = log.withColumn("_sum", F.sum("delta").over(order))
    # a count that can't go below nothing: the running sum above its lowest point so far
    floor = F.least(F.min("_sum").over(order), F.lit(0))
    counted = run.withColumn("count", F.col("_sum") - floor)
    before = F.coalesce(F.lag("count").over(Window.partitionBy("proposal").orderBy("seq")), F.lit(0))
    changed = counted.withColumn("_before", before)
    change = F.when((F.col("count") == 0) & (F.col("_before") > 0), "undone").when((F.col("count") > 0) & (F.col("_before") == 0), "redone")
    return changed.withColumn("change", change).where("change IS NOT NULL").select("proposal", "seq", "change", F.col("count").cast("long").alias("count"))


def reverse_index(proposals: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows (role, pkey, proposal): what a selected feature leads to. Candidates count only
    for proposals whose building is still to be picked."""
    address = proposals.select(F.lit("address").alias("role"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("pkey"), F.col("id").alias("proposal"))
    target = proposals.where("target IS NOT NULL").select(F.lit("building").alias("role"), F.concat(F.lit("b"), F.col("target").cast("string")).alias("pkey"), F.col("id").alias("proposal"))
    parcel = proposals.where("cell_id IS NOT NULL").select(F.lit("parcel").alias("role"), F.col("cell_id").alias("pkey"), F.col("id").alias("proposal"))
    pick = candidates.join(proposals.where("bucket = 'AMBIGUOUS_BUILDING'").select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_semi")
    pick = pick.select(F.lit("building").alias("role"), F.concat(F.lit("b"), F.col("bid").cast("string")).alias("pkey"), F.col("id").alias("proposal"))
    return address.unionByName(target).unionByName(parcel).unionByName(pick).distinct()
