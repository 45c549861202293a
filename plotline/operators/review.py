"""Lists that a reviewer works through, and test beds that tell how good the match is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators.settings import BULK_BUCKETS, bucket_rank
from plotline.spread import numbered

# Keys beside addr: that leave a node a plain address.
PLAIN_KEYS = ("source", "check_date")


def in_order(proposals: DataFrame) -> DataFrame:
    """Proposals with ``place`` from 0: by bucket, sure ones first among CLEAN, doubtful ones
    first elsewhere, then by id."""
    doubt = F.when(F.col("bucket") == "CLEAN", -F.col("confidence")).otherwise(F.col("confidence"))
    return numbered(proposals.withColumns({"_b": bucket_rank(F.col("bucket")), "_d": doubt}), "_b", "_d", "id").withColumnRenamed("_n", "place").drop("_b", "_d")


def bulk(proposals: DataFrame, bucket: Column | str, applied: DataFrame) -> DataFrame:
    """What applying a whole bucket applies: its proposals that are not applied yet, if it is
    one of those that may be applied without a look."""
    wanted = F.lit(bucket) if isinstance(bucket, str) else bucket
    return proposals.where((F.col("bucket") == wanted) & F.col("bucket").isin(*BULK_BUCKETS)).join(applied.select("id"), "id", "left_anti")


def highlights(proposals: DataFrame, groups: DataFrame, candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """The elements to show for each proposal (id, elements): its source nodes, its building,
    the alternatives where the building is to be picked, and the existing addresses found.
    Candidates are (id, bid) in order, existing ones (id, eid)."""
    own = proposals.join(groups.select("id", "dup_ids"), "id")
    named = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    picks = candidates.join(own.where("bucket = 'AMBIGUOUS_BUILDING'").select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set(named("b", F.col("bid")))).alias("_picks"))
    found = existing.groupBy("id").agg(F.array_sort(F.collect_set(named("e", F.col("eid")))).alias("_found"))
    none = F.array().cast("array<string>")
    rows = own.join(picks, "id", "left").join(found, "id", "left")
    nodes = F.transform(F.concat(F.array("id"), "dup_ids"), lambda i: named("n", i))
    target = F.when(F.col("target").isNotNull(), F.array(named("b", F.col("target")))).otherwise(none)
    return rows.select("id", F.array_distinct(F.concat(nodes, target, F.coalesce("_picks", none), F.coalesce("_found", none))).alias("elements"))


def within_rows(selection: Column, elements: Column) -> Column:
    """Whether every selected element is shown by the rows' elements."""
    return F.size(F.array_except(selection, elements)) == 0


def address_centre(nodes: DataFrame) -> DataFrame:
    """The middle of the box round all nodes with a house number (one row; null without any)."""
    return nodes.where("number IS NOT NULL").agg(((F.min("x") + F.max("x")) / 2).alias("x"), ((F.min("y") + F.max("y")) / 2).alias("y"))


def match_scores(proposals: DataFrame, truth: DataFrame) -> DataFrame:
    """For each bucket: proposals, those sent to a building, and those sent to the right one (id, bid)."""
    rows = proposals.join(truth.select("id", F.col("bid").alias("_right")), "id", "left")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("assigned"), F.count_if(F.col("target") == F.col("_right")).alias("correct"))


def carrier_kind(tags: Column) -> Column:
    """What carries an address: a building, a feature of its own, or a node that is nothing else."""
    other = F.exists(F.map_keys(tags), lambda k: ~F.startswith(k, F.lit("addr:")) & ~k.isin(*PLAIN_KEYS))
    numbered_ = F.map_contains_key(tags, "addr:housenumber")
    return F.when(~numbered_, F.lit(None)).when(F.map_contains_key(tags, "building"), "building").when(other, "poi").otherwise("standalone")


def stripped(elements: DataFrame, generic: bool = False) -> DataFrame:
    """Elements (id, tags) without their addresses; bare address nodes go, and buildings are
    made plain ones if ``generic``."""
    kind = carrier_kind(F.col("tags"))
    tags = F.map_filter("tags", lambda k, v: ~F.startswith(k, F.lit("addr:")))
    if generic:
        tags = F.transform_values(tags, lambda k, v: F.when(k == "building", "yes").otherwise(v))
    return elements.where(F.coalesce(kind != "standalone", F.lit(True))).withColumn("tags", tags)


def share_of(key: Column, salt: str) -> Column:
    """A number from 0 to 1 that depends on the key alone, for samples that can be repeated."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def perturbed(tags: Column, key: Column) -> Column:
    """Tags with a fault by chance: the unit lost, or the number off by two."""
    roll = share_of(key, "roll")
    number = F.try_element_at(tags, F.lit("addr:housenumber")).try_cast("bigint")
    off = (number + F.when(share_of(key, "side") < 0.5, -2).otherwise(2)).cast("string")
    wrong = F.transform_values(tags, lambda k, v: F.when((k == "addr:housenumber") & off.isNotNull(), off).otherwise(v))
    return F.when(roll < 0.15, wrong).when(roll < 0.25, F.map_filter(tags, lambda k, v: k != "addr:unit")).otherwise(tags)
