"""Runs of road pieces joined end to end, street by street, and places along them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators.graph import components
from plotline.operators.quality import along, roads_near, side_of
from plotline.session import ship
from plotline.spread import dealt, stored

MAX_TURN = 120.0
#: Longest loop, in metres, that is the bulb at the end of a street and not a street.
MAX_BULB = 300.0
RADIUS = 100.0
MIN_OFFSET = 3.0
#: A differently named road this much closer makes a corner.
CORNER_RATIO = 0.4
# Service roads that do not carry a street on.
DRIVEWAYS = ("driveway", "parking_aisle")


def turn(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float]) -> float:
    """Change of direction at b, in degrees."""
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - b[0], c[1] - b[1]
    norm = math.hypot(ux, uy) * math.hypot(vx, vy)
    return math.degrees(math.acos(max(-1.0, min(1.0, (ux * vx + uy * vy) / norm)))) if norm else 0.0


def chain(ways: list[tuple[int, list[int]]], place: dict[int, tuple[float, float]]) -> list[tuple[list[int], list[int]]]:
    """Chains (nodes, ways) of one street: each grows at its tail, then at its head, by the
    unused way that turns least, up to MAX_TURN; the later of equal ones is taken. A ring
    may be walked either way round."""
    free = {way: nodes for way, nodes in ways if len(nodes) > 1}
    ends: dict[int, list[int]] = {}
    for way, nodes in free.items():
        for node in dict.fromkeys((nodes[0], nodes[-1])):
            ends.setdefault(node, []).append(way)
    out = []
    for first in list(free):
        if first not in free:
            continue
        run, used = list(free.pop(first)), [first]
        for _ in range(2):
            while True:
                best = None
                for way in ends.get(run[-1], ()):
                    for pts in (free[way], free[way][::-1]) if way in free else ():
                        if pts[0] == run[-1]:
                            t = turn(place[run[-2]], place[run[-1]], place[pts[1]])
                            if t <= MAX_TURN and (best is None or t <= best[0]):
                                best = (t, way, pts)
                if best is None:
                    break
                run += best[2][1:]
                used.append(best[1])
                del free[best[1]]
            run.reverse()
        out.append((run, used))
    return out


def looped(nodes: list[int], place: dict[int, tuple[float, float]]) -> list[bool]:
    """For each piece of a run whether it lies on a bulb: between two visits of a node that
    are at most MAX_BULB apart along the run."""
    at, first, out = [0.0], {}, [False] * max(0, len(nodes) - 1)
    for a, b in zip(nodes, nodes[1:]):
        at.append(at[-1] + math.dist(place[a], place[b]))
    for i, node in enumerate(nodes):
        f = first.setdefault(node, i)
        if f < i and at[i] - at[f] <= MAX_BULB:
            out[f:i] = [True] * (i - f)
    return out


def road_chains(roads: DataFrame) -> DataFrame:
    """Chains (key, chain, nodes, ways, xs, ys, loops) of roads (key, way, nodes, xs, ys);
    ``chain`` is the number of its first way.

    Only ways that are connected can be in one chain, so each connected part of a street
    is a group: a name that is common in a country is many groups. Ways are taken in the
    order of their ids.
    """
    ship(roads.sparkSession)
    named = roads.select("key", "way", F.explode(F.array_distinct(F.array(F.col("nodes")[0], F.element_at("nodes", -1)))).alias("_end"))
    first = named.groupBy("key", "_end").agg(F.min("way").alias("_first"))
    touching = named.join(first, ["key", "_end"]).where("way <> _first")
    edges = touching.select(F.struct("key", F.col("_first").alias("way")).alias("_a"), F.struct("key", "way").alias("_b"))
    parts = components(edges).select(F.col("_node.key").alias("key"), F.col("_node.way").alias("way"), F.col("_root.way").alias("_part"))
    grouped = roads.join(parts, ["key", "way"], "left").withColumn("_part", F.coalesce("_part", "way"))
    # rows of groups, as a pandas frame for each of many small ones would take most of the time
    streets = grouped.groupBy("key", "_part").agg(F.array_sort(F.collect_list(F.struct("way", "nodes", "xs", "ys"))).alias("_ways"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, ways in zip(batch["key"], batch["_ways"]):
                place = {int(n): (float(x), float(y)) for r in ways for n, x, y in zip(r["nodes"], r["xs"], r["ys"])}
                for nodes, used in chain([(int(r["way"]), [int(n) for n in r["nodes"]]) for r in ways], place):
                    rows.append((key, used[0], nodes, used, [place[n][0] for n in nodes], [place[n][1] for n in nodes], looped(nodes, place)))
            yield pd.DataFrame(rows, columns=["key", "chain", "nodes", "ways", "xs", "ys", "loops"])

    schema = "key string, chain long, nodes array<long>, ways array<long>, xs array<double>, ys array<double>, loops array<boolean>"
    return dealt(streets, "key", "_part").select("key", "_ways").mapInPandas(run, schema)


def dead_ends(chains: DataFrame, roads: DataFrame) -> DataFrame:
    """Chains with dead_start and dead_end: whether no road but its own, and no driveway,
    uses the end's node and the run passes it once. ``roads`` (way, nodes, service) are all
    roads, whatever their names."""
    used = roads.where(~F.coalesce(F.col("service").isin(*DRIVEWAYS), F.lit(False))).select(F.col("way").alias("_way"), F.explode(F.array_distinct("nodes")).alias("_node")).distinct()
    ends = chains.select("key", "chain", "ways", F.explode(F.array(F.struct(F.lit("s").alias("w"), F.col("nodes")[0].alias("n")), F.struct(F.lit("e").alias("w"), F.element_at("nodes", -1).alias("n")))).alias("_e"))
    open_ends = ends.join(used, F.col("_e.n") == F.col("_node")).where(~F.array_contains("ways", F.col("_way")))
    joined = open_ends.groupBy("key", "chain").agg(F.bool_or(F.col("_e.w") == "s").alias("_js"), F.bool_or(F.col("_e.w") == "e").alias("_je"))
    once = lambda n: F.size(F.filter("nodes", lambda m: m == n)) == 1
    rows = chains.join(joined, ["key", "chain"], "left")
    dead = lambda j, n: once(n) & ~F.coalesce(j, F.lit(False))
    return rows.withColumns({"dead_start": dead(F.col("_js"), F.col("nodes")[0]), "dead_end": dead(F.col("_je"), F.element_at("nodes", -1))}).drop("_js", "_je")


def chain_pieces(chains: DataFrame) -> DataFrame:
    """The pieces of chains, in order, with the metres up to each (run)."""
    points = F.transform("xs", lambda x, i: F.struct(x.alias("x"), F.element_at("ys", (i + 1).cast("int")).alias("y")))
    pieces = F.zip_with(F.slice(points, 1, F.size("xs") - 1), F.slice(points, 2, F.size("xs") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = chains.withColumn("_pieces", pieces)
    length = lambda p: F.sqrt(F.pow(p["b"]["x"] - p["a"]["x"], 2) + F.pow(p["b"]["y"] - p["a"]["y"], 2))
    runs = F.aggregate("_pieces", F.array(F.lit(0.0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + length(p))))
    rows = rows.withColumn("_runs", runs).select("key", "chain", "dead_start", "dead_end", F.size("_pieces").alias("n"), "_runs", "loops", F.posexplode("_pieces").alias("i", "_p"))
    return rows.select(
        "key", "chain", "dead_start", "dead_end", "n", "i", F.element_at("_runs", F.col("i") + 1).alias("run"), F.element_at("loops", F.col("i") + 1).alias("loop"),
        F.col("_p.a.x").alias("ax"), F.col("_p.a.y").alias("ay"), F.col("_p.b.x").alias("bx"), F.col("_p.b.y").alias("by"),
    ).where("ax <> bx OR ay <> by")


def _metres(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Metres along the chain, how far the point is past its end, and which end (-1, 0, 1)."""
    length = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    at = along(x, y)
    end = F.when((at < 0) & (F.col("i") == 0), -1).when((at > length) & (F.col("i") == F.col("n") - 1), 1).otherwise(0)
    past = F.when(end == -1, -at).when(end == 1, at - length).otherwise(0.0)
    own = F.col("run") + F.greatest(F.lit(0.0), F.least(length, at))
    carried = F.when((end == -1) & F.col("dead_start"), own - past).when((end == 1) & F.col("dead_end"), own + past).otherwise(own)
    return F.round(carried, 9), F.round(past, 9), end


def placed_on_chains(addresses: DataFrame, pieces: DataFrame, outlines: DataFrame | None = None, radius: float = RADIUS) -> DataFrame:
    """Addresses (id, x, y, ns, house) at the nearest chain of their own street, the first of
    equals: side, metres along (at), the stretch that their outline (id, x, y) spans
    (low, high), whether they lie ahead of its dead end (head) or beside a bulb (loop).

    Left out are those beyond ``radius``, those too near the line to have a side, those
    ahead of an end where another road goes on, and corner houses: there a road of
    another name is much closer.
    """
    points = addresses.where("house >= 0").select("id", "x", "y", "ns", "house")
    near = stored(roads_near(points, pieces, radius), "near-chains")
    own = near.where("ns = key").groupBy("id").agg(F.min(F.struct("distance", "chain", "i", "key", "n", "run", "loop", "dead_start", "dead_end", "ax", "ay", "bx", "by", "x", "y", "house")).alias("r")).select("id", "r.*")
    at, past, end = _metres(F.col("x"), F.col("y"))
    length = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    cross = (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("x") - F.col("ax"))
    own = own.withColumns({"side": side_of(F.col("x"), F.col("y")), "at": at, "past": past, "end": end, "offset": F.round(F.abs(cross) / length, 9)})
    own = own.withColumn("head", F.col("past") > F.col("offset"))
    goes_on = F.col("head") & ~F.when(F.col("end") == -1, F.col("dead_start")).otherwise(F.col("dead_end"))
    other = near.where("ns <> key").groupBy(F.col("id").alias("_o")).agg(F.min("distance").alias("_other"))
    own = own.join(other, F.col("id") == F.col("_o"), "left")
    corner = F.coalesce(F.col("_other") <= F.round(CORNER_RATIO * F.col("distance"), 9), F.lit(False))
    kept = own.where((F.col("distance") >= MIN_OFFSET) & (F.col("side") != 0) & ~goes_on & ~corner).select("id", "key", "chain", "side", "at", "house", "head", "loop")
    if outlines is None:
        return kept.withColumns({"low": F.col("at"), "high": F.col("at")})
    return stored(kept, "on-chains").join(_stretches(kept, pieces, outlines), F.col("id") == F.col("_s"), "left").select(
        *kept.columns, F.coalesce(F.least("at", "_low"), "at").alias("low"), F.coalesce(F.greatest("at", "_high"), "at").alias("high")
    )


def _stretches(placed: DataFrame, pieces: DataFrame, outlines: DataFrame) -> DataFrame:
    """The least and greatest metres along an address's chain of its outline's points (_s, _low, _high)."""
    points = outlines.select(F.col("id").alias("_s"), F.col("x").alias("_px"), F.col("y").alias("_py")).distinct()
    of = placed.select(F.col("id").alias("_i"), F.col("chain").alias("_chain"), F.col("key").alias("_key"))
    rows = points.join(of, F.col("_s") == F.col("_i")).withColumnsRenamed({"_px": "x", "_py": "y"})
    near = roads_near(rows, pieces, 4 * RADIUS).where((F.col("chain") == F.col("_chain")) & (F.col("key") == F.col("_key")))
    best = near.groupBy("_s", "x", "y").agg(F.min(F.struct("distance", "i", "n", "run", "dead_start", "dead_end", "ax", "ay", "bx", "by")).alias("r")).select("_s", "x", "y", "r.*")
    at, _, _ = _metres(F.col("x"), F.col("y"))
    return best.withColumn("_at", at).groupBy("_s").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
