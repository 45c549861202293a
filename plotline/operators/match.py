"""The match of addresses to buildings by way of cells, and the sorting into buckets.

Shapes are columns with a prefix, boxes or general polygons (see functions.shapes); every
join is a grid join on their boxes or an equi-join on ids.

Addresses:  id, x, y, number, street, unit, place, exact, and nn, ns, nu (see
            functions.address.with_normal)
Cells:      cell_id and a shape c
Buildings:  bid, building, factor, a shape b, b_number, b_street,
            b_unit, b_place, b_exact (null without an address), b_nn, b_ns, b_nu
Existing:   eid, ex, ey, e_number, e_street, e_unit, e_place, e_exact, e_nn, e_ns, e_nu
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions import address as A
from plotline.functions.shapes import in_shape, shape_area, shape_columns, shape_distance, shape_overlap
from plotline.operators.grid import grid_join, with_box
from plotline.operators.settings import GENERIC_BUILDINGS, KIND_CONFIDENCE, OTHER_KIND_CONFIDENCE, MatchSettings, bucket_rank
from plotline.spread import stored

GRID = 40.0
NO_CELL = "<none>"
PARTS = ("street", "place", "exact", "nn", "ns", "nu")


def address_columns(prefix: str = "") -> dict[str, Column]:
    return {p: F.col(prefix + p) for p in PARTS}


def assign_cells(addresses: DataFrame, cells: DataFrame, settings: MatchSettings) -> DataFrame:
    """Addresses with cell_id, snapped and cell_distance: the smallest cell that holds the
    point, edges included, or else the nearest within the match distance; ties by id.
    One join, and one partial aggregate per address, finds both."""
    shapes = cells.select("cell_id", *shape_columns(cells, "c"), shape_area(cells, "c").alias("_area"))  # once for each cell
    near = grid_join(with_box(addresses.select("id", "x", "y"), "p", "x", "y", settings.match_distance), shapes, "p", "c", GRID)
    # no filter, below which Spark would compute the distance a second time
    near = near.select("id", "cell_id", "_area", shape_distance(near, "c", F.col("x"), F.col("y")).alias("d"))
    place = F.struct((F.col("d") > 0).alias("snapped"), F.when(F.col("d") > 0, F.col("d")).otherwise(F.col("_area")).alias("m"), F.col("cell_id").alias("cell_id"), F.col("d").alias("d"))
    best = F.min(F.when(F.col("d") <= settings.match_distance, place))
    found = near.groupBy(F.col("id").alias("_id")).agg(best.alias("b"))
    joined = addresses.join(found, F.col("id") == F.col("_id"), "left")
    return joined.select(*addresses.columns, F.col("b.cell_id").alias("cell_id"), F.coalesce("b.snapped", F.lit(False)).alias("snapped"), F.coalesce("b.d", F.lit(0.0)).alias("cell_distance"))


def group_addresses(located: DataFrame) -> DataFrame:
    """One row per distinct address and cell: the row of the lowest id, the ids of its
    duplicates, and whether the same address lies in another cell too."""
    rest = [c for c in located.columns if c not in ("id", "exact", "cell_id")]
    keyed = located.withColumn("_cell", F.coalesce("cell_id", F.lit(NO_CELL)))
    groups = keyed.groupBy("exact", "_cell").agg(
        F.min(F.struct("id", "cell_id", *rest)).alias("first"), F.array_sort(F.collect_list("id")).alias("ids")
    )
    spread = groups.groupBy(F.col("exact").alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.join(spread, F.col("exact").eqNullSafe(F.col("_e"))).select(
        F.col("first.id").alias("id"), "exact", F.col("first.cell_id").alias("cell_id"), *[F.col(f"first.{c}").alias(c) for c in rest],
        F.slice("ids", 2, F.size("ids")).alias("dup_ids"), (F.col("_n") > 1).alias("cross_dup"),
    )


def building_cells(buildings: DataFrame, cells: DataFrame, addressed: DataFrame, settings: MatchSettings, parcels: bool = True) -> DataFrame:
    """Pairs of building and cell with area_in, share and score. With parcels, a building
    that an addressed parcel holds but for the tolerance belongs to the parcel that holds
    most of it; slivers of too small a share and area are no pairs."""
    shapes = buildings.select("bid", "factor", *shape_columns(buildings, "b"), shape_area(buildings, "b").alias("area"))  # once for each building
    pairs = grid_join(shapes, cells.select("cell_id", *shape_columns(cells, "c")), "b", "c", GRID)
    # stored, as the home parcels read it too; the filter comes after, so that overlaps are computed once
    pairs = stored(pairs.select("bid", "cell_id", "factor", "area", shape_overlap(pairs, "b", "c").alias("area_in")), "overlaps").where(F.col("area_in") > 0)
    pairs = pairs.withColumn("share", F.col("area_in") / F.col("area"))
    if parcels:
        with_address = addressed.select(F.col("cell_id").alias("_addressed")).distinct()
        homes = pairs.where(F.col("share") >= 1 - settings.split_tolerance).join(with_address, F.col("cell_id") == F.col("_addressed"), "left_semi")
        homes = homes.groupBy(F.col("bid").alias("_b")).agg(F.min(F.struct((-F.col("share")).alias("s"), F.col("cell_id").alias("home")))["home"].alias("_home"))
        pairs = pairs.join(homes, F.col("bid") == F.col("_b"), "left").where(F.col("_home").isNull() | (F.col("_home") == F.col("cell_id")))
    kept = pairs.where((F.col("share") >= settings.min_share) | (F.col("area_in") >= settings.min_area))
    return kept.select("bid", "cell_id", "area_in", "share", (F.col("area_in") * F.col("factor")).alias("cell_score"))


def rank_buildings(groups: DataFrame, cell_buildings: DataFrame, buildings: DataFrame, settings: MatchSettings, synthetic: bool = False) -> DataFrame:
    """Candidates of each group with score and rank, and the runner-up's ratio on rank 1.

    Candidates are the cell's buildings and those that hold the point without being the
    cell's. Equal scores keep the order: the cell's by their own score, then the others,
    then by id."""
    points = groups.where(F.col("cell_id").isNotNull() & ~F.col("cross_dup"))
    holding = grid_join(with_box(points.select("id", "x", "y"), "p", "x", "y"), buildings.select("bid", *shape_columns(buildings, "b")), "p", "b", GRID, in_shape(buildings, "b", F.col("x"), F.col("y"), strict=True))
    holding = holding.select("id", "bid", F.lit(True).alias("holds"))
    own = points.select("id", "cell_id").join(cell_buildings.select("cell_id", "bid", "cell_score"), "cell_id").select("id", "bid", "cell_score")
    both = own.join(holding, ["id", "bid"], "full")
    detail = both.join(buildings, "bid").join(points.select("id", "x", "y", *PARTS), "id")
    area = shape_area(buildings, "b")
    extra = F.col("cell_score").isNull()
    generic = F.coalesce(F.col("building").isin(*GENERIC_BUILDINGS), F.lit(True))
    explicit = F.max((F.col("factor") >= 1) & ~generic).over(Window.partitionBy("id"))
    detail = detail.withColumns({"extra": extra, "base": F.coalesce("cell_score", area * F.col("factor")), "holds": F.coalesce("holds", F.lit(False)), "explicit": explicit})
    if synthetic:
        detail = detail.where(F.col("holds") | (shape_distance(detail, "b", F.col("x"), F.col("y")) <= settings.match_distance))
    score = F.col("base")
    score = F.when(F.col("explicit") & ~F.col("holds") & generic & (F.col("factor") >= 1), score * settings.generic_beside_explicit).otherwise(score)
    score = F.when(F.col("holds") & (F.col("factor") >= 1), score * settings.contains_factor).otherwise(score)
    detail = detail.withColumn("kind", A.compare(address_columns(), address_columns("b_")))
    score = F.when(F.col("b_exact").isNotNull() & F.col("kind").isNull(), score * settings.other_address_factor).otherwise(score)
    order = Window.partitionBy("id").orderBy(F.desc("score"), "extra", F.desc("base"), "bid")
    ranked = detail.withColumn("score", score).withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    ratio = F.when(F.col("score") > 0, F.coalesce(F.col("next") / F.col("score"), F.lit(0.0))).otherwise(0.0)
    return ranked.withColumn("ratio", ratio)


def existing_in_cells(existing: DataFrame, cells: DataFrame) -> DataFrame:
    """Existing addresses with every cell that holds their point, edges included."""
    return grid_join(with_box(existing, "q", "ex", "ey"), cells, "q", "c", GRID, in_shape(cells, "c", F.col("ex"), F.col("ey"))).select(*existing.columns, "cell_id")


def best_existing(groups: DataFrame, located: DataFrame) -> DataFrame:
    """For each group with a matching existing address in its cell: the strongest kind and
    how many match. Kinds other than none imply equal house numbers, so the join is on
    cell and house number."""
    a = groups.where(F.col("cell_id").isNotNull())
    e = located.withColumnRenamed("cell_id", "_c")
    pairs = a.join(e, (F.col("cell_id") == F.col("_c")) & (F.col("nn") == F.col("e_nn")))
    pairs = pairs.withColumn("kind", A.compare(address_columns(), address_columns("e_"))).where("kind IS NOT NULL")
    ordinal = A.kind_rank(F.col("kind"))
    return pairs.groupBy("id").agg(F.min(F.struct(ordinal.alias("o"), F.col("kind").alias("kind")))["kind"].alias("existing_kind"), F.count(F.lit(1)).alias("n_existing"))


def kind_confidence(kind: Column) -> Column:
    out = F.lit(OTHER_KIND_CONFIDENCE)
    for name, value in KIND_CONFIDENCE.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def bucket_addresses(groups: DataFrame, ranked: DataFrame, cell_buildings: DataFrame, existing: DataFrame | None, settings: MatchSettings) -> DataFrame:
    """Rows id, bucket, confidence, target, ratio, kind: the first rule that fits.

    Rules about the group come first; groups that none of them decides are assigned to
    their best building, and the rules about buildings see all of its groups."""
    top = ranked.where("rank = 1").select(
        F.col("id").alias("_t"), "bid", "ratio", "kind", F.col("b_exact").isNotNull().alias("_has"), shape_distance(ranked, "b", F.col("x"), F.col("y")).alias("_far")
    )
    rows = groups.join(top, F.col("id") == F.col("_t"), "left")
    if existing is None:
        rows = rows.withColumns({"existing_kind": F.lit(None).cast("string"), "n_existing": F.lit(0)})
    else:
        rows = rows.join(existing.withColumnRenamed("id", "_x"), F.col("id") == F.col("_x"), "left")
    strong = F.col("existing_kind").isin("IDENTICAL", "PARTIAL") & (F.col("n_existing") == 1)
    kept = F.col("kind").isin("IDENTICAL", "PARTIAL")
    fixed = (
        F.when(F.col("cell_id").isNull(), "OUTSIDE_CELLS")
        .when(F.col("cross_dup"), "DUPLICATE")
        .when(strong, F.when(F.col("existing_kind") == "PARTIAL", "FILL_EXISTING").otherwise("CLEAN"))
        .when(F.col("existing_kind").isNotNull(), "EXISTING_ADDRESS")
        .when(F.col("bid").isNull(), "NO_BUILDING")
        .when(F.col("_has") & kept, F.when(F.col("kind") == "PARTIAL", "FILL_EXISTING").otherwise("CLEAN"))
        .when(F.col("_has"), "EXISTING_ADDRESS")
    )
    found_kind = F.when(F.col("existing_kind").isNotNull(), F.col("existing_kind")).when(F.col("_has"), F.coalesce("kind", F.lit("OTHER_ADDRESS_ON_BUILDING")))
    rows = rows.withColumn("fixed", fixed).withColumn("found_kind", found_kind)
    given = (
        F.when(F.col("fixed") == "OUTSIDE_CELLS", 0.0).when(F.col("fixed") == "DUPLICATE", 0.2).when(F.col("fixed") == "NO_BUILDING", 0.9).otherwise(kind_confidence(F.col("found_kind")))
    )
    decided = rows.where("fixed IS NOT NULL").select(
        "id", F.col("fixed").alias("bucket"), given.alias("confidence"),
        F.when(F.col("fixed").isin("CLEAN", "FILL_EXISTING", "EXISTING_ADDRESS") & F.col("existing_kind").isNull(), F.col("bid")).alias("target"),
        F.lit(0.0).alias("ratio"), F.when(~F.col("fixed").isin("OUTSIDE_CELLS", "DUPLICATE", "NO_BUILDING"), F.col("found_kind")).alias("kind"),
    )
    open_rows = rows.where("fixed IS NULL").select("id", "bid", "cell_id", "ratio", "snapped", "_far")
    shares = cell_buildings.select(F.col("bid").alias("_sb"), F.col("cell_id").alias("_sc"), "share")
    open_rows = open_rows.join(shares, (F.col("bid") == F.col("_sb")) & (F.col("cell_id") == F.col("_sc")), "left")
    per = open_rows.groupBy(F.col("bid").alias("_pb")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("cells"), F.max("ratio").alias("worst"), F.bool_or("snapped").alias("any_snapped"),
        F.max("_far").alias("far"), F.min(F.coalesce("share", F.lit(0.0))).alias("least_share"),
    )
    start = 1 - 0.5 * F.col("worst") - F.when(F.col("any_snapped"), 0.1).otherwise(0.0)
    many = F.col("n") > 1
    first = (
        F.when(F.col("cells") > 1, "REVIEW")
        .when(F.col("worst") >= settings.ambiguity_ratio, "AMBIGUOUS_BUILDING")
        .when(many & (F.col("worst") >= settings.multi_ambiguity_ratio), "AMBIGUOUS_BUILDING")
        .when(many, "MULTI_ADDRESS_BUILDING")
        .otherwise("CLEAN")
    )
    most = (
        F.when(F.col("cells") > 1, 0.6).when(F.col("worst") >= settings.ambiguity_ratio, 0.5).when(many & (F.col("worst") >= settings.multi_ambiguity_ratio), 0.4).when(many, 0.85).otherwise(1.0)
    )
    per = per.withColumn("bucket", first).withColumn("confidence", F.least(start, most))
    far = F.col("far") > settings.far_match
    per = per.withColumn("bucket", F.when(far & F.col("bucket").isin("CLEAN", "MULTI_ADDRESS_BUILDING"), "AMBIGUOUS_BUILDING").otherwise(F.col("bucket")))
    per = per.withColumn("confidence", F.when(far, F.least("confidence", F.lit(0.4))).otherwise(F.col("confidence")))
    split = F.col("bucket").isin("CLEAN", "MULTI_ADDRESS_BUILDING") & (F.col("least_share") < 1 - settings.split_tolerance)
    per = per.withColumn("confidence", F.when(split, F.least("confidence", F.lit(0.6))).otherwise(F.col("confidence")))
    per = per.withColumn("bucket", F.when(split, "REVIEW").otherwise(F.col("bucket")))
    assigned = open_rows.join(per, F.col("bid") == F.col("_pb")).select(
        "id", "bucket", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")).alias("confidence"), F.col("bid").alias("target"), "ratio", F.lit(None).cast("string").alias("kind")
    )
    return decided.unionByName(assigned)


def shared_building_pass(proposals: DataFrame, groups: DataFrame, buildings: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Proposals with keeps_node: an address alone on a building stays a node where it is a
    lone unit, or where the footprint holds another address that is not sent elsewhere."""
    known = groups.select(F.col("id").alias("_g"), "x", "y", "unit", "nn", "ns")
    rows = proposals.join(known, F.col("id") == F.col("_g"))
    alone = rows.where(F.col("target").isNotNull()).groupBy(F.col("target").alias("_tb")).agg(F.count(F.lit(1)).alias("_on"))
    rows = rows.join(alone, F.col("target") == F.col("_tb"), "left")
    tags_building = F.coalesce(F.col("target").isNotNull() & (F.col("_on") == 1) & F.col("kind").isNull() & F.col("bucket").isin("CLEAN", "REVIEW", "AMBIGUOUS_BUILDING"), F.lit(False))
    rows = rows.withColumn("_one", tags_building)
    has_unit = ~A.blank(F.col("unit"))
    rows = rows.withColumn("_plain", F.concat_ws("|", "nn", "ns"))
    units = rows.where(has_unit & F.col("target").isNotNull()).groupBy(F.col("_plain").alias("_p")).agg(F.count_distinct("target").alias("_buildings"))
    rows = rows.join(units, F.col("_plain") == F.col("_p"), "left")
    lone_unit = has_unit & (F.coalesce("_buildings", F.lit(0)) <= 1)
    mine = rows.where("_one").select(F.col("id").alias("_mine"), F.col("target").alias("_bid"))
    mine = mine.join(buildings.select(F.col("bid").alias("_b2"), *shape_columns(buildings, "b")), F.col("_bid") == F.col("_b2"))
    other = with_box(rows.select(F.col("id").alias("_oid"), F.col("x").alias("_ox"), F.col("y").alias("_oy"), F.col("target").alias("_ot")), "o", "_ox", "_oy")
    inside = in_shape(buildings, "b", F.col("_ox"), F.col("_oy"), strict=True)
    hits = grid_join(mine, other, "b", "o", GRID, inside & (F.col("_oid") != F.col("_mine")) & (F.col("_ot").isNull() | (F.col("_ot") == F.col("_bid")))).select("_mine")
    if existing is not None:
        there = with_box(existing.select(F.col("ex").alias("_ox"), F.col("ey").alias("_oy")), "o", "_ox", "_oy")
        hits = hits.unionByName(grid_join(mine, there, "b", "o", GRID, inside).select("_mine"))
    hits = hits.distinct().withColumn("_shared", F.lit(True))
    rows = rows.join(hits, F.col("id") == F.col("_mine"), "left")
    unit, shared = F.col("_one") & lone_unit, F.col("_one") & F.coalesce("_shared", F.lit(False))
    bucket = F.when(unit & (F.col("bucket") == "CLEAN"), "REVIEW").when(shared & (F.col("bucket") == "CLEAN"), "MULTI_ADDRESS_BUILDING").otherwise(F.col("bucket"))
    return rows.select("id", bucket.alias("bucket"), "confidence", "target", "ratio", "kind", (unit | shared).alias("keeps_node"))


def grouped_pairs(addresses: DataFrame, cells: DataFrame, buildings: DataFrame, settings: MatchSettings, synthetic: bool = False) -> tuple[DataFrame, DataFrame]:
    """The first steps of the match, written: groups of addresses, and pairs of building and cell."""
    groups = stored(group_addresses(assign_cells(addresses, cells, settings)), "groups")
    return groups, stored(building_cells(buildings, cells, groups.where("cell_id IS NOT NULL"), settings, parcels=not synthetic), "pairs")


def match_groups(groups: DataFrame, pairs: DataFrame, cells: DataFrame, buildings: DataFrame, existing: DataFrame | None, settings: MatchSettings, synthetic: bool = False) -> DataFrame:
    """The match from there on."""
    ranked = rank_buildings(groups, pairs, buildings, settings, synthetic)
    matches = best_existing(groups, existing_in_cells(existing, cells)) if existing is not None else None
    proposals = stored(bucket_addresses(groups, ranked, pairs, matches, settings), "proposals")
    return shared_building_pass(proposals, groups, buildings, existing)


def match_addresses(addresses: DataFrame, cells: DataFrame, buildings: DataFrame, existing: DataFrame | None = None, settings: MatchSettings | None = None, synthetic: bool = False) -> DataFrame:
    """The whole match: one proposal per distinct address and cell. Cells are parcels, or,
    if ``synthetic``, made from the addresses (see operators.site_cells)."""
    settings = settings or MatchSettings()
    return match_groups(*grouped_pairs(addresses, cells, buildings, settings, synthetic), cells, buildings, existing, settings, synthetic)


def ordered(proposals: DataFrame) -> DataFrame:
    """In the order of buckets; sure ones first among CLEAN, doubtful ones first elsewhere."""
    return proposals.withColumn("bucket_ord", bucket_rank(F.col("bucket"))).orderBy("bucket_ord", F.when(F.col("bucket") == "CLEAN", -F.col("confidence")).otherwise(F.col("confidence")), "id")
