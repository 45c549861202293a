"""Places for address nodes inside a building's footprint, or beside a building mapped as a node.

Each place depends on those taken before it, so a building's nodes are placed in id order
by one task. They come as a stream, sorted by building: a task keeps the places taken in
the current building, which its area bounds, and no group of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.geometry import box_ring
from plotline.session import ship

KEEP_APART = 0.5
PLACE_APART = 2.0
STEP = 3.0
RINGS = 39
STAND_IN = 6.0
BESIDE_RINGS = 3

Point = tuple[float, float]


class Taken:
    """Places taken so far, by squares of PLACE_APART, so that only near ones are compared."""

    def __init__(self) -> None:
        self.squares: dict[tuple[int, int], list[Point]] = {}

    def add(self, p: Point) -> None:
        own = self.squares.setdefault((math.floor(p[0] / PLACE_APART), math.floor(p[1] / PLACE_APART)), [])
        if p not in own:
            own.append(p)

    def clear(self, p: Point, apart: float) -> bool:
        i, j = math.floor(p[0] / PLACE_APART), math.floor(p[1] / PLACE_APART)
        return all(math.dist(p, t) >= apart for k in (i - 1, i, i + 1) for m in (j - 1, j, j + 1) for t in self.squares.get((k, m), ()))


def squares() -> Iterator[tuple[int, int]]:
    """Steps east and north on growing squares, from their south-western corner northwards."""
    for ring in range(1, RINGS + 1):
        for i in range(-ring, ring + 1):
            for j in range(-ring, ring + 1) if abs(i) == ring else (-ring, ring):
                yield i, j


def strictly_inside(rings: list[np.ndarray]) -> Callable[[Point], bool]:
    """Whether a point is inside an odd number of rings (n x 2, closed) and on none."""
    a = np.concatenate([r[:-1] for r in rings])
    b = np.concatenate([r[1:] for r in rings])

    def test(p: Point) -> bool:
        x, y = p
        cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
        near = (np.minimum(a, b) <= p).all(axis=1) & (np.maximum(a, b) >= p).all(axis=1)
        if (near & (cross == 0)).any():
            return False
        up = (a[:, 1] > y) != (b[:, 1] > y)
        return bool((up & ((cross > 0) == (b[:, 1] > a[:, 1]))).sum() % 2)

    return test


class Footprint:
    """Places inside one footprint, given one after another.

    A point's own place if it is inside and clear of those taken, else the middle, else
    the first clear spot on growing squares round it, else the middle. Spots once taken
    stay so, so that the search goes on where it ended.
    """

    def __init__(self, rings: list[np.ndarray], middle: Point):
        self.inside, self.middle = strictly_inside(rings), middle
        self.taken, self.spots = Taken(), squares()
        self.spot: Point | None = middle

    def place(self, p: Point) -> Point:
        if self.inside(p) and self.taken.clear(p, KEEP_APART):
            got = p
        else:
            while self.spot is not None and not self.taken.clear(self.spot, PLACE_APART):
                self.spot = next((q for i, j in self.spots if self.inside(q := (self.middle[0] + i * STEP, self.middle[1] + j * STEP))), None)
            got = self.middle if self.spot is None else self.spot
        self.taken.add(got)
        return got


class Beside:
    """Places near a building's node, given one after another: a point's own place if it is
    within the node's stand-in circle and clear of the node and of those placed, else the
    first clear spot in eight directions on rings round the node, else one ring's width
    east of it."""

    def __init__(self, node: Point):
        self.node, self.taken = node, Taken()
        self.taken.add(node)

    def place(self, p: Point) -> Point:
        got = (self.node[0] + PLACE_APART, self.node[1])
        if math.dist(p, self.node) < STAND_IN and self.taken.clear(p, KEEP_APART):
            got = p
        else:
            for k in range(8 * BESIDE_RINGS):
                reach, turn = (k // 8 + 1) * PLACE_APART, k % 8 * math.pi / 4
                q = (self.node[0] + reach * math.cos(turn), self.node[1] + reach * math.sin(turn))
                if self.taken.clear(q, PLACE_APART):
                    got = q
                    break
        self.taken.add(got)
        return got


def place_inside(points: list[Point], rings: list[list[Point]], middle: Point) -> list[Point]:
    footprint = Footprint([np.array(r, float) for r in rings], middle)
    return [footprint.place(p) for p in points]


def place_beside(points: list[Point], node: Point) -> list[Point]:
    beside = Beside(node)
    return [beside.place(p) for p in points]


def _streamed(rows: DataFrame, key: str, begin: Callable, columns: list[str]) -> DataFrame:
    """Places (id, key, px, py), ``begin`` starting each new key's from its ``columns``."""
    ship(rows.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, placer = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if placer is None or r[1] != now:
                    now, placer = r[1], begin(*r[4:])
                out.append((r[0], r[1], *placer.place((r[2], r[3]))))
            yield pd.DataFrame(out, columns=["id", key, "px", "py"])

    types = {c: rows.schema[c].dataType.simpleString() for c in ("id", key)}
    ordered = rows.where(F.col(key).isNotNull()).select("id", key, "x", "y", *columns).repartition(key).sortWithinPartitions(key, "id")
    return ordered.mapInPandas(run, f"id {types['id']}, {key} {types[key]}, px double, py double")


def placed_inside(nodes: DataFrame, key: str = "bid") -> DataFrame:
    """Places (id, key, px, py) of nodes (id, key, x, y) in footprints (rings) with a middle
    (ix, iy)."""

    def corners(c: str) -> Column:
        return F.transform("rings", lambda r: F.transform(r, lambda p: p[c]))

    flat = nodes.withColumns({"_x": corners("x"), "_y": corners("y")})
    return _streamed(flat, key, lambda ix, iy, xs, ys: Footprint([np.column_stack([x, y]) for x, y in zip(xs, ys)], (ix, iy)), ["ix", "iy", "_x", "_y"])


def placed(nodes: DataFrame) -> DataFrame:
    """Places (id, bid, px, py) of nodes (id, bid, x, y) in boxes (bxmin, bymin, bxmax, bymax)."""
    middle = {"ix": (F.col("bxmin") + F.col("bxmax")) / 2, "iy": (F.col("bymin") + F.col("bymax")) / 2}
    return placed_inside(nodes.withColumns(middle | {"rings": F.array(box_ring("b"))}))


def placed_beside(addresses: DataFrame, key: str = "node_id") -> DataFrame:
    """Places (id, key, px, py) of addresses (id, key, x, y) near nodes at mx, my."""
    return _streamed(addresses, key, lambda mx, my: Beside((mx, my)), ["mx", "my"])
