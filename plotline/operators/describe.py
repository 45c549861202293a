"""What a person is told of proposals: the address, where it goes, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.shapes import shape_area, shape_distance
from plotline.operators.settings import MatchSettings


def described(number: Column, street: Column, unit: Column) -> Column:
    """An address in one line: number, unit behind #, street."""
    return F.trim(F.concat(F.coalesce(number, F.lit("?")), F.coalesce(F.concat(F.lit(" #"), unit), F.lit("")), F.lit(" "), F.coalesce(street, F.lit(""))))


def described_all(many: Column, first: Column) -> Column:
    """Several addresses of one proposal, by the first of them."""
    return F.when(many == 1, first).otherwise(F.concat(many.cast("string"), F.lit(" addresses: "), first, F.lit(" ...")))


def whole(value: Column) -> Column:
    return F.round(value).cast("long").cast("string")


def row_label(said: Column, bucket: Column, found: Column, layer: Column, kind: Column, area: Column, candidates: Column, confidence: Column) -> Column:
    """A proposal's line in a list: the address, where it goes, and how sure that is.

    ``found`` is the element that has the address already, ``kind`` and ``area`` are the
    target's, ``candidates`` how many buildings there are to pick from.
    """
    what = F.coalesce(kind, F.lit("?"))
    size = F.concat(F.lit(" ("), whole(area), F.lit(" m²)"))
    goes = (
        F.when((bucket == "CLEAN") & found.isNotNull(), F.concat(F.lit(" → already on "), found))
        .when((bucket == "FILL_EXISTING") & found.isNotNull(), F.concat(F.lit(" → fills "), found))
        .when(layer == "node", F.concat(F.lit(" → building node "), what))
        .when(layer == "hint", F.concat(F.lit(" → hint "), what, size))
        .when(layer == "building", F.concat(F.lit(" → building="), what, size))
        .when((bucket == "AMBIGUOUS_BUILDING") & (candidates > 0), F.concat(F.lit(" → pick one of "), candidates.cast("string"), F.lit(" buildings")))
    )
    return F.concat(said, F.coalesce(goes, F.lit("")), F.lit("  "), whole(confidence * 100), F.lit("%"))


def building_reasons(proposals: DataFrame, groups: DataFrame, ranked: DataFrame, pairs: DataFrame, buildings: DataFrame, settings: MatchSettings) -> DataFrame:
    """Rows (target, proposal, addresses, reasons) for the buildings that addresses were
    assigned to; ``proposal`` is the least of these. What is said of the candidates is said
    of those of that address."""
    rows = proposals.where("kind IS NULL AND target IS NOT NULL").select("id", "target", "bucket")
    known = groups.select(F.col("id").alias("_g"), "cell_id", "snapped", "cell_distance")
    rows = rows.join(known, F.col("id") == F.col("_g")).drop("_g")
    far = shape_distance(ranked, "b", F.col("x"), F.col("y"))
    top = ranked.where("rank = 1").select(F.col("id").alias("_t"), F.col("bid").alias("_bid"), "ratio", "holds", far.alias("_far"))
    rows = rows.join(top, (F.col("id") == F.col("_t")) & (F.col("target") == F.col("_bid")))
    shares = pairs.select(F.col("bid").alias("_sb"), F.col("cell_id").alias("_sc"), "share")
    rows = rows.join(shares, (F.col("target") == F.col("_sb")) & (F.col("cell_id") == F.col("_sc")), "left")
    share = F.coalesce("share", F.lit(0.0))
    per = rows.groupBy("target").agg(
        F.min("id").alias("proposal"), F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("cells"), F.max("ratio").alias("worst"), F.bool_and("holds").alias("inside"),
        F.bool_or("snapped").alias("snapped"), F.max("cell_distance").alias("away"), F.max("_far").alias("far"), F.min_by("cell_id", "id").alias("cell"),
        F.min(share).alias("least"), F.min_by("cell_id", F.struct(share, F.col("cell_id"))).alias("least_cell"),
    )
    counts = ranked.groupBy(F.col("id").alias("_c")).agg(F.max("rank").alias("candidates"))
    second = ranked.where("rank = 2").select(F.col("id").alias("_2"), shape_area(ranked, "b").alias("_area2"), F.col("building").alias("_kind2"))
    own = buildings.select(F.col("bid").alias("_b"), shape_area(buildings, "b").alias("_area"))
    per = per.join(counts, F.col("proposal") == F.col("_c")).join(second, F.col("proposal") == F.col("_2"), "left").join(own, F.col("target") == F.col("_b"))
    n, worst, many = F.col("n"), F.col("worst"), F.col("n") > 1
    unsure = (worst >= settings.ambiguity_ratio) | (many & (worst >= settings.multi_ambiguity_ratio))
    beyond = F.col("far") > settings.far_match
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    largest = text("Largest of ", F.col("candidates"), " buildings in parcel ", F.col("cell"), " (", whole(F.col("_area")), " m² against ", whole(F.col("_area2")), " m² of building=", F.coalesce("_kind2", F.lit("?")), ")")
    shared = text(n, " addresses share the parcel with ", F.col("candidates"), " buildings")
    split = (F.col("cells") == 1) & ~unsure & ~beyond & (F.col("least") < 1 - settings.split_tolerance)
    reasons = F.array(
        F.when(F.col("candidates") > 1, largest).otherwise(text("Only building in parcel ", F.col("cell"))),
        F.when(worst > 0, text("Runner-up scores ", whole(worst * 100), "% of it")),
        F.when(F.col("inside"), F.when(many, "All address points are inside").otherwise("Address point is inside")),
        F.when(F.col("snapped"), text("Address point snapped to a parcel ", whole(F.col("away")), " m away")),
        F.when(F.col("cells") > 1, text("Covers ", F.col("cells"), " addressed parcels"))
        .when(unsure & many, shared)
        .when(~unsure & many, text(n, " addresses; each stays a node")),
        F.when(beyond, text(whole(F.col("far")), " m from the address point")),
        F.when(split, text("A parcel line splits it: only ", whole(F.col("least") * 100), "% is in parcel ", F.col("least_cell"))),
    )
    return per.select("target", "proposal", n.alias("addresses"), F.array_compact(reasons).alias("reasons"))
