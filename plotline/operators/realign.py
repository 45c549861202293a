"""Layers that lie beside each other: how far, moving them, and matching again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.geometry import box_ring
from plotline.functions.shapes import BOX, SHAPE, ring_signs, rings_centroid, shape_area
from plotline.operators.match import grouped_pairs, match_groups
from plotline.operators.settings import MatchSettings
from plotline.operators.spacing import even_sample, shift_estimate
from plotline.spread import stored

# Fixed values of the estimates.
LEAST_ADDRESSES, SIGNIFICANT_ADDRESSES, SIGNIFICANT_METRES, SIGNIFICANT_SPREAD = 5, 20, 5, 0.5
USUAL_AREA = (20, 3000)
MOST_BUILDINGS, MOST_POINTS, APART = 300, 120, 1.0

ADDRESSES, PARCELS = "addresses", "parcels"


def estimate(offsets: DataFrame) -> DataFrame:
    """Shift of a set of offsets (dx, dy): medians, spread (median distance from them), and
    whether it is significant; no row for fewer than five."""
    middle = offsets.agg(F.median("dx").alias("mx"), F.median("dy").alias("my"))  # one row
    both = offsets.crossJoin(F.broadcast(middle))
    out = both.agg(
        F.first("mx").alias("dx"), F.first("my").alias("dy"), F.count(F.lit(1)).alias("samples"),
        F.median(F.sqrt(F.pow(F.col("dx") - F.col("mx"), 2) + F.pow(F.col("dy") - F.col("my"), 2))).alias("spread"),
    ).where(f"samples >= {LEAST_ADDRESSES}")
    distance = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    significant = (F.col("samples") >= SIGNIFICANT_ADDRESSES) & (distance >= SIGNIFICANT_METRES) & (F.col("spread") < SIGNIFICANT_SPREAD * distance)
    return out.select(*[F.round(c, 6).alias(c) for c in ("dx", "dy", "spread")], "samples", significant.alias("significant"))


def centre_offsets(proposals: DataFrame, addresses: DataFrame, buildings: DataFrame) -> DataFrame:
    """Offsets (dx, dy) from each clean address to the centre of the building it goes to alone."""
    clean = proposals.where("bucket = 'CLEAN' AND target IS NOT NULL").select("id", "target")
    rings = F.col("brings") if "brings" in buildings.columns else F.array(box_ring("b"))
    centres = buildings.select(F.col("bid").alias("_b"), rings_centroid(rings).alias("_c"))
    rows = clean.join(addresses.select(F.col("id").alias("_a"), "x", "y"), F.col("id") == F.col("_a")).join(centres, F.col("target") == F.col("_b"))
    return rows.select((F.col("_c.x") - F.col("x")).alias("dx"), (F.col("_c.y") - F.col("y")).alias("dy"))


def outline_points(shapes: DataFrame, key: str, rings: Column, apart: float = APART, most: int = MOST_POINTS) -> DataFrame:
    """Points (key, x, y) along the outer rings, from the first corner on, ``apart`` metres
    from each other, or further so that there are about ``most`` on a ring."""
    outer = shapes.withColumn("_r", rings).select(key, F.explode(F.filter("_r", lambda r, i: F.element_at(ring_signs(F.col("_r")), (i + 1).cast("int")) > 0)).alias("_ring"))
    pairs = F.zip_with(F.slice("_ring", 1, F.size("_ring") - 1), F.slice("_ring", 2, F.size("_ring") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    length = lambda e: F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2))
    start = F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>,at:double,len:double>>")
    end = lambda acc: F.coalesce(F.element_at(acc, -1)["at"] + F.element_at(acc, -1)["len"], F.lit(0.0))
    so_far = lambda acc: F.when(F.size(acc) > 0, end(acc)).otherwise(0.0)
    edges = F.aggregate(pairs, start, lambda acc, e: F.concat(acc, F.array(F.struct(e["a"].alias("a"), e["b"].alias("b"), so_far(acc).alias("at"), length(e).alias("len")))))
    rows = outer.withColumn("_e", edges).withColumn("_all", so_far(F.col("_e"))).where("_all > 0")
    rows = rows.withColumn("_step", F.greatest(F.lit(apart), F.col("_all") / most))
    rows = rows.withColumn("_n", F.ceil(F.round(F.col("_all") / F.col("_step"), 9)).cast("int"))
    each = rows.select(key, "_e", "_step", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k")).withColumn("_d", F.col("_k") * F.col("_step"))
    each = each.withColumn("_on", F.element_at(F.filter("_e", lambda e: (e["at"] <= F.col("_d")) & (e["len"] > 0)), -1))
    share = (F.col("_d") - F.col("_on.at")) / F.col("_on.len")
    return each.select(key, *[(F.col(f"_on.a.{c}") + share * (F.col(f"_on.b.{c}") - F.col(f"_on.a.{c}"))).alias(c) for c in "xy"])


def outline_samples(buildings: DataFrame, most: int = MOST_BUILDINGS) -> DataFrame:
    """Outline points (bid, x, y) of an even sample of buildings of usual size, which is what
    the search for a shift looks at."""
    area = shape_area(buildings, "b")
    usual = buildings.where((area >= USUAL_AREA[0]) & (area <= USUAL_AREA[1]))
    rings = F.col("brings") if "brings" in buildings.columns else F.array(box_ring("b"))
    return outline_points(even_sample(usual, "bid", most), "bid", rings)


def moved_points(points: DataFrame, dx: float, dy: float) -> DataFrame:
    return points.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def moved_shapes(shapes: DataFrame, prefix: str, dx: float, dy: float) -> DataFrame:
    """Shapes moved, with whatever columns of a shape they have."""
    by = {"xmin": dx, "xmax": dx, "ymin": dy, "ymax": dy}
    out = {prefix + c: F.col(prefix + c) + by[c] for c in BOX}
    rings, edges = (prefix + c for c in SHAPE)
    if rings in shapes.columns:
        out[rings] = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))))
        moved = lambda e: F.struct((e["x0"] + dx).alias("x0"), (e["y0"] + dy).alias("y0"), (e["x1"] + dx).alias("x1"), (e["y1"] + dy).alias("y1"), e["s"].alias("s"))
        out[edges] = F.transform(edges, moved)
    return shapes.withColumns(out)


@dataclass(frozen=True)
class Settled:
    """The match after the last move, the layers as it saw them, and what was found on the
    way: (round, layer, dx, dy, samples, significant, moved)."""

    proposals: DataFrame
    addresses: DataFrame
    cells: DataFrame
    shifts: DataFrame


def settle(
    addresses: DataFrame, cells: DataFrame, buildings: DataFrame, existing: DataFrame | None = None, settings: MatchSettings | None = None,
    synthetic: bool = False, declined: tuple[str, ...] = (), rounds: int = 3,
) -> Settled:
    """Match, move the layers that lie beside the buildings, and match again, until no shift
    is significant or ``rounds`` matches have been followed by a move.

    Layers in ``declined`` are measured and left where they are. Cells made from the
    addresses are no layer of their own: they move with these, so that the caller makes
    them anew; only parcels are measured. Where more addresses lie in several cells than
    are clean, as on a map of many towns that have the same addresses, those are measured
    too; the proposals still tell them apart. Three rows reach the driver each round.
    """
    spark, log, settings = addresses.sparkSession, [], settings or MatchSettings()
    samples = stored(outline_samples(buildings), "outlines") if not synthetic else None
    for turn in range(rounds + 1):
        groups, pairs = grouped_pairs(addresses, cells, buildings, settings, synthetic)
        proposals = stored(match_groups(groups, pairs, cells, buildings, existing, settings, synthetic), "settled")
        found = {ADDRESSES: estimate(centre_offsets(proposals, addresses, buildings)).first()}
        if proposals.agg(F.count_if(F.col("bucket") == "DUPLICATE") > F.count_if(F.col("bucket") == "CLEAN")).first()[0]:
            each = match_groups(groups.withColumn("cross_dup", F.lit(False)), pairs, cells, buildings, existing, settings, synthetic)
            found[ADDRESSES] = estimate(centre_offsets(stored(each, "each"), addresses, buildings)).first()
        if samples is not None:
            found[PARCELS] = shift_estimate(samples, cells).first()
        go = {k: r for k, r in found.items() if r is not None and r["significant"] and k not in declined and turn < rounds}
        log += [(turn, k, r["dx"], r["dy"], r["samples"], r["significant"], k in go) for k, r in found.items() if r is not None]
        if not go:
            break
        if ADDRESSES in go:
            addresses = moved_points(addresses, go[ADDRESSES]["dx"], go[ADDRESSES]["dy"])
        if PARCELS in go:
            cells = moved_shapes(cells, "c", go[PARCELS]["dx"], go[PARCELS]["dy"])
        if synthetic:
            break
    shifts = spark.createDataFrame(log, "round int, layer string, dx double, dy double, samples long, significant boolean, moved boolean")
    return Settled(proposals, addresses, cells, shifts)


def run_summary(addresses: DataFrame, groups: DataFrame, cells: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row: addresses, duplicates dropped, cells and proposals, those for one building
    being one."""
    shared = F.when(F.col("kind").isNull() & F.col("target").isNotNull(), F.concat(F.lit("b"), F.col("target").cast("string"))).otherwise(F.concat(F.lit("n"), F.col("id").cast("string")))
    counts = [
        addresses.agg(F.count(F.lit(1)).alias("addresses")), groups.agg(F.coalesce(F.sum(F.size("dup_ids")), F.lit(0)).cast("long").alias("duplicates")),
        cells.agg(F.count(F.lit(1)).alias("cells")), proposals.agg(F.count_distinct(shared).alias("proposals")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(F.broadcast(c))  # one row each
    return out
