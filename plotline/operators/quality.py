"""Checks of addresses against their streets, neighbours and buildings.

Points are x, y in metres; roads are straight pieces ax, ay, bx, by with road_id and a
street key (see functions.address.normalize_street); a key may have several pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions import address as A
from plotline.functions import names as N
from plotline.functions.geometry import segment_distance
from plotline.functions.shapes import in_shape, shape_area
from plotline.operators.elements import leaves_bounds
from plotline.operators.grid import grid_join, with_box

ROAD_RADIUS = 60.0
STREET_RADIUS = 200.0
CORNER_RADIUS = 25.0
CORNER_FACTOR = 2.0
NEIGHBOUR_RADIUS = 60.0
MAX_NEIGHBOURS = 6
MIN_NEIGHBOURS = 4
AGREEMENT = 0.75
MIN_GAP = 8.0
MIN_SIDE = 3
MIN_PARITY_SIDE = 4
PARITY_SHARE = 0.8
SIDE_NEAREST = 3.0
SIDE_FARTHEST = 100.0
LARGE_BUILDING = 500.0
STREET_RELATIONS = ("associatedStreet", "street")


def side_of(x: Column, y: Column) -> Column:
    """1 left of the road piece, -1 right of it, 0 on its line."""
    cross = (F.col("bx") - F.col("ax")) * (y - F.col("ay")) - (F.col("by") - F.col("ay")) * (x - F.col("ax"))
    return F.signum(cross).cast("int")


def along(x: Column, y: Column) -> Column:
    """Metres along the road piece to the foot of the point."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return ((x - F.col("ax")) * dx + (y - F.col("ay")) * dy) / F.sqrt(dx * dx + dy * dy)


def roads_near(points: DataFrame, roads: DataFrame, radius: float) -> DataFrame:
    """Pairs of point and road piece at most ``radius`` apart, with the distance, to a nanometre."""
    boxed = roads.withColumns(
        {"rxmin": F.least("ax", "bx"), "rymin": F.least("ay", "by"), "rxmax": F.greatest("ax", "bx"), "rymax": F.greatest("ay", "by")}
    )
    pairs = grid_join(with_box(points, "p", "x", "y", radius), boxed, "p", "r", max(60.0, radius))
    pairs = pairs.drop("pxmin", "pymin", "pxmax", "pymax", "rxmin", "rymin", "rxmax", "rymax")
    distance = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return pairs.withColumn("distance", F.round(distance, 9)).where(F.col("distance") <= radius)


def road_names(roads: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """Every name of a road (road_id, name), once: its name tags' and those of the street
    relations (rel_id, tags) it is a member of (rel_id, road_id)."""
    own = roads.select("road_id", F.explode(N.display_names(F.col("tags"))).alias("name"))
    return own.unionByName(relation_names(relations, members, "road_id")).distinct()


def relation_names(relations: DataFrame, members: DataFrame, member: str) -> DataFrame:
    """Names of the street relations that a member is in (member, name)."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    streets = relations.where(tag("type").isin(*STREET_RELATIONS)).select("rel_id", F.explode(A.split_values(tag("name"))).alias("name"))
    return members.join(streets, "rel_id").select(member, "name")


def street_names(
    addresses: DataFrame, roads: DataFrame, radius: float = STREET_RADIUS, names: DataFrame | None = None, exempt: DataFrame | None = None, bounds: DataFrame | None = None,
    with_road: bool = False,
) -> DataFrame:
    """Streets of addresses that no road within ``radius`` has: NEAR_MATCH with the nearest
    road of a name that is the same but for spelling, else NO_ROAD, or NO_ROAD_AT_EDGE if
    the search leaves the downloaded ``bounds`` (dxmin, dymin, dxmax, dymax).

    A street of several parts between semicolons is checked part by part. ``names``
    (road_id, name) are the roads' names, their own column else; ``exempt`` (id, name)
    are streets that addresses belong to by other means. Without roads nothing is said.
    ``with_road`` adds the near road's id.
    """
    more = [F.col("close.road_id").alias("road_id")] if with_road else []
    if not roads.take(1):
        nothing = addresses.select("id", "street", F.lit("").alias("problem"), F.lit("").alias("road")).limit(0)
        return nothing.crossJoin(roads.select("road_id")) if with_road else nothing
    parts = addresses.where(~A.blank(F.col("street"))).select("id", "x", "y", F.explode(A.split_values(F.col("street"))).alias("street"))
    parts = parts.withColumn("_key", N.street_key(F.col("street")))
    if exempt is not None:
        named = exempt.select(F.col("id").alias("_i"), N.canonical(F.col("name")).alias("_canon")).distinct()
        parts = parts.withColumn("_c", N.canonical(F.col("street"))).join(named, (F.col("id") == F.col("_i")) & (F.col("_c") == F.col("_canon")), "left_anti").drop("_c")
    names = roads.select("road_id", "name").distinct() if names is None else names
    names = names.select(F.col("road_id").alias("_r"), F.col("name").alias("_name"), N.street_key(F.col("name")).alias("_nkey"))
    near = roads_near(parts.select("id", "x", "y").distinct(), roads.select("road_id", "ax", "ay", "bx", "by"), radius).select("id", "road_id", "distance")
    near = near.groupBy("id", "road_id").agg(F.min("distance").alias("distance")).join(names, F.col("road_id") == F.col("_r"))
    # only a road of the part's key can settle it
    seen = parts.select(F.col("id").alias("_id"), "street", "_key").join(near, (F.col("_id") == F.col("id")) & (F.col("_key") == F.col("_nkey")))
    seen = seen.groupBy("_id", F.col("street").alias("_s")).agg(F.bool_or(F.col("street") == F.col("_name")).alias("verbatim"), F.min(F.struct("distance", "road_id", "_name")).alias("close"))
    rows = parts.join(seen, (F.col("id") == F.col("_id")) & (F.col("street") == F.col("_s")), "left").where(~F.coalesce("verbatim", F.lit(False)))
    missing = F.lit("NO_ROAD")
    if bounds is not None:
        rows = leaves_bounds("s", bounds, with_box(rows, "s", "x", "y", radius))
        missing = F.when(F.col("leaves"), "NO_ROAD_AT_EDGE").otherwise("NO_ROAD")
    return rows.select("id", "street", F.when(F.col("close").isNotNull(), "NEAR_MATCH").otherwise(missing).alias("problem"), F.col("close._name").alias("road"), *more)


def neighbour_streets(addresses: DataFrame, roads: DataFrame) -> DataFrame:
    """Addresses whose street differs from the one that their neighbours and road agree on.

    The road beside the address has another street's name, the own street is near but
    not so near that this is a corner, and enough of the nearest neighbours on the same
    side of the road are in the road's street.
    """
    return agreeing_neighbours(addresses, roads).drop("near")


def agreeing_neighbours(addresses: DataFrame, roads: DataFrame) -> DataFrame:
    """As ``neighbour_streets``, with the agreeing neighbours' ids (near), nearest first."""
    points = addresses.select("id", "x", "y", F.col("ns").alias("own"))
    near = roads_near(points, roads.select("road_id", "key", "ax", "ay", "bx", "by"), STREET_RADIUS)
    beside = near.where(F.col("distance") <= ROAD_RADIUS).groupBy("id").agg(F.min(F.struct("distance", "road_id", "key", "ax", "ay", "bx", "by", "x", "y", "own")).alias("r"))
    beside = beside.select("id", "r.*").withColumn("side", side_of(F.col("x"), F.col("y"))).where("side <> 0 AND key <> own")
    own = near.where("key = own").groupBy(F.col("id").alias("_o")).agg(F.min("distance").alias("own_distance"))
    beside = beside.join(own, F.col("id") == F.col("_o")).where(F.col("own_distance") > F.greatest(F.lit(CORNER_RADIUS), CORNER_FACTOR * F.col("distance")))
    others = with_box(points.select(F.col("id").alias("nid"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("own").alias("nkey")), "n", "nx", "ny")
    pairs = grid_join(with_box(beside, "s", "x", "y", NEIGHBOUR_RADIUS), others, "s", "n", NEIGHBOUR_RADIUS)
    apart = F.sqrt(F.pow(F.col("nx") - F.col("x"), 2) + F.pow(F.col("ny") - F.col("y"), 2))
    pairs = pairs.withColumn("d", apart).where((F.col("nid") != F.col("id")) & (F.col("d") <= NEIGHBOUR_RADIUS) & (side_of(F.col("nx"), F.col("ny")) == F.col("side")))
    order = Window.partitionBy("id").orderBy("d", "nid")
    first = pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= MAX_NEIGHBOURS)
    near_first = F.transform(F.array_sort(F.collect_list(F.struct("rn", "nid"))), lambda v: v["nid"])  # at most MAX_NEIGHBOURS
    votes = first.groupBy("id", "own", "key", "nkey").agg(F.count(F.lit(1)).alias("n"), near_first.alias("near"))
    most = F.struct("n", "nkey")
    best = votes.groupBy("id", "own", "key").agg(F.sum("n").alias("all"), F.max_by("nkey", most).alias("other"), F.max("n").alias("agree"), F.max_by("near", most).alias("near"))
    return best.where((F.col("all") >= MIN_NEIGHBOURS) & (F.col("other") != F.col("own")) & (F.col("agree") >= AGREEMENT * F.col("all")) & (F.col("other") == F.col("key"))).select(
        "id", F.col("own").alias("street"), F.col("other").alias("expected"), F.col("agree").alias("agreeing"), F.col("all").alias("neighbours"), "near"
    )


def placed_on_streets(addresses: DataFrame, roads: DataFrame, nearest_side: float = SIDE_NEAREST, farthest_side: float = SIDE_FARTHEST) -> DataFrame:
    """Addresses with the piece of their own street they lie at: side, metres along and number."""
    near = roads_near(addresses.select("id", "x", "y", "ns", "house"), roads.select("road_id", "key", "ax", "ay", "bx", "by"), farthest_side).where("ns = key")
    nearest = near.groupBy("id").agg(F.min(F.struct("distance", "road_id", "ax", "ay", "bx", "by", "x", "y", "house", "key")).alias("r")).select("id", "r.*")
    placed = nearest.withColumns({"side": side_of(F.col("x"), F.col("y")), "at": along(F.col("x"), F.col("y"))})
    return placed.where((F.col("distance") >= nearest_side) & (F.col("side") != 0) & (F.col("house") >= 0)).select("id", "road_id", "key", "side", "at", "house")


def out_of_sequence(placed: DataFrame) -> DataFrame:
    """Numbers that are not between their two neighbours on the side though these are in
    the street's order, told by the net direction over both sides."""
    order = Window.partitionBy("road_id", "side").orderBy("at", "id")
    rows = placed.withColumns(
        {"before": F.lag("house").over(order), "after": F.lead("house").over(order), "at0": F.lag("at").over(order), "at1": F.lead("at").over(order), "n": F.count(F.lit(1)).over(Window.partitionBy("road_id", "side"))}
    )
    steps = rows.groupBy(F.col("road_id").alias("_r")).agg(F.sum(F.signum(F.col("house") - F.col("before"))).alias("net"))
    rows = rows.join(steps, F.col("road_id") == F.col("_r")).withColumn("dir", F.signum("net").cast("int"))
    a, b, c = (F.col("dir") * F.col(x) for x in ("before", "house", "after"))
    wrong = (a < c) & (((b < a) & (F.col("at") - F.col("at0") >= MIN_GAP)) | ((b > c) & (F.col("at1") - F.col("at") >= MIN_GAP)))
    return rows.where((F.col("n") >= MIN_SIDE) & (F.col("dir") != 0) & wrong).select("id", "road_id", "side", "house", "before", "after")


def wrong_parity(placed: DataFrame) -> DataFrame:
    """Numbers whose parity is not that of nearly all numbers on their side."""
    side = Window.partitionBy("road_id", "side")
    rows = placed.withColumns({"n": F.count(F.lit(1)).over(side), "even": F.sum(F.when(F.col("house") % 2 == 0, 1).otherwise(0)).over(side)})
    usual = F.when(F.col("even") >= PARITY_SHARE * F.col("n"), 0).when(F.col("n") - F.col("even") >= PARITY_SHARE * F.col("n"), 1)
    return rows.where((F.col("n") >= MIN_PARITY_SIDE) & usual.isNotNull() & (F.col("house") % 2 != usual)).select("id", "road_id", "side", "house")


def nodes_in_buildings(addresses: DataFrame, buildings: DataFrame, large: float = LARGE_BUILDING) -> DataFrame:
    """Address nodes strictly inside the smallest building around them whose own address
    differs in number or street; minor where the building is shared or has two fronts."""
    held = grid_join(with_box(addresses.select("id", "x", "y", "nn", "ns"), "p", "x", "y"), buildings, "p", "b", 40.0, in_shape(buildings, "b", F.col("x"), F.col("y"), strict=True))
    held = held.withColumn("area", shape_area(held, "b"))
    inside = held.groupBy(F.col("bid").alias("_b")).agg(F.count(F.lit(1)).alias("inside"))
    smallest = held.groupBy("id").agg(F.min(F.struct("area", "bid", "b_nn", "b_ns", "nn", "ns", "b_exact")).alias("s")).select("id", "s.*")
    streets_differ = (F.col("ns") != "") & (F.col("b_ns") != "") & (F.col("ns") != F.col("b_ns"))
    rows = smallest.where(F.col("b_exact").isNotNull() & ((F.col("nn") != F.col("b_nn")) | streets_differ)).join(inside, F.col("bid") == F.col("_b"))
    minor = (F.col("inside") >= 2) | (streets_differ & (F.col("area") >= large))
    return rows.select("id", "bid", F.when(minor, "OTHER").otherwise("WARNING").alias("severity"), "inside")
