"""Polygons from the ways of a map: closed ways, and multipolygons assembled from members."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.session import ship

RINGS = "array<array<struct<x:double,y:double>>>"


def stitched(ways: list[list[int]]) -> list[list[int]]:
    """Closed rings of nodes from ways that meet end to end, in the order of the ways; what
    does not close is dropped."""
    free = {i: list(w) for i, w in enumerate(ways) if len(w) > 1}
    ends: dict[int, set[int]] = {}
    for i, w in free.items():
        for node in (w[0], w[-1]):
            ends.setdefault(node, set()).add(i)
    out = []
    for first in list(free):
        if first not in free:
            continue
        ring = free.pop(first)
        while ring[0] != ring[-1]:
            following = min((i for i in ends[ring[-1]] if i in free), default=None)
            if following is None:
                break
            way = free.pop(following)
            ring += way[1:] if way[0] == ring[-1] else way[-2::-1]
        if ring[0] == ring[-1] and len(ring) > 3:
            out.append(ring)
    return out


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways (way_id, nodes) with their nodes' places in order (way_id, nodes, points); ways
    with a node that is not there are left out."""
    each = ways.select("way_id", F.size("nodes").alias("_size"), F.posexplode("nodes").alias("_i", "_n"))
    placed = each.join(nodes.select(F.col("node_id").alias("_n"), "x", "y"), "_n")
    found = placed.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("_i", "_n", "x", "y"))).alias("_p"), F.count(F.lit(1)).alias("_k"), F.max("_size").alias("_size"))
    found = found.where("_k = _size")
    return found.select("way_id", F.transform("_p", lambda p: p["_n"]).alias("nodes"), F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def closed_ways(points: DataFrame) -> DataFrame:
    """Rings of the ways that end where they begin (way_id, rings)."""
    closed = (F.size("nodes") > 3) & (F.col("nodes")[0] == F.element_at("nodes", -1))
    return points.where(closed).select("way_id", F.array("points").alias("rings"))


def multipolygons(members: DataFrame, points: DataFrame) -> DataFrame:
    """Rings of relations (rel_id, rings) from members (rel_id, way_id, seq, role) and the
    ways' points. Outer and inner rings are stitched apart, in the order of the members; a
    relation without an outer ring has no polygon. A relation is one row, which holds the
    border of one area; a batch of them passes Python at once."""
    ship(members.sparkSession)
    rows = members.where(F.coalesce(F.col("role"), F.lit("")).isin("", "outer", "inner")).join(points, "way_id")
    member = F.struct(F.col("seq").isNull().alias("last"), "seq", "way_id", "role", "nodes", "points")
    whole = rows.groupBy("rel_id").agg(F.array_sort(F.collect_list(member)).alias("_m"))
    whole = whole.select("rel_id", "_m.role", "_m.nodes", "_m.points")
    return whole.mapInArrow(_assembled, f"rel_id long, rings {RINGS}")


def _assembled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of relations (rel_id, role, nodes, points), with a list for each member, the rings."""

    def starts(lists: pa.Array) -> list[int]:
        return np.r_[0, np.cumsum(np.asarray(pc.list_value_length(lists)))].tolist()

    for batch in batches:
        rel_id, role, nodes, points = batch.columns
        way_at, role = starts(role), role.flatten().to_pylist()
        nodes, points = nodes.flatten(), points.flatten()
        node_at, point_at, nodes, points = starts(nodes), starts(points), nodes.flatten().to_pylist(), points.flatten()
        kept, ring_at, corner_at, corners = [], [0], [0], []
        for i in range(batch.num_rows):
            place: dict[int, int] = {}
            outer, inner = [], []
            for w in range(way_at[i], way_at[i + 1]):
                way = nodes[node_at[w] : node_at[w + 1]]
                place.update(zip(way, range(point_at[w], point_at[w + 1])))
                (inner if role[w] == "inner" else outer).append(way)
            rings = stitched(outer)
            if not rings:
                continue
            for ring in rings + stitched(inner):
                corners += [place[n] for n in ring]
                corner_at.append(len(corners))
            kept.append(i)
            ring_at.append(len(corner_at) - 1)
        xy = points.take(pa.array(corners, pa.int64()))
        rings = pa.ListArray.from_arrays(pa.array(ring_at, pa.int32()), pa.ListArray.from_arrays(pa.array(corner_at, pa.int32()), xy))
        yield pa.record_batch([rel_id.take(pa.array(kept, pa.int64())), rings], ["rel_id", "rings"])
