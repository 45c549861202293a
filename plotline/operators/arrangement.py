"""The pieces into which lines cut a cell.

The cell's border and the lines are split where they meet; what leads nowhere, that is
ends of lines and lines between otherwise separate parts, is taken away; the faces that
are left within the cell are its pieces. Cells are small, so that all of a cell's lines
are compared with each other.
"""

from __future__ import annotations

import math

import numpy as np

#: Points nearer to each other than this are one, in metres.
SNAP = 1e-6
ON = 1e-9


class Vertices:
    """Numbers of points, equal for points that are at most about SNAP apart."""

    def __init__(self) -> None:
        self.points: list[tuple[float, float]] = []
        self.at: dict[tuple[int, int], int] = {}

    def number(self, x: float, y: float) -> int:
        i, j = math.floor(x / SNAP), math.floor(y / SNAP)
        for k in ((i, j), *((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1))):
            n = self.at.get(k)
            if n is not None and math.dist(self.points[n], (x, y)) <= SNAP:
                return n
        self.points.append((x, y))
        self.at[i, j] = len(self.points) - 1
        return len(self.points) - 1


def noded(segments: np.ndarray) -> tuple[list[tuple[float, float]], set[tuple[int, int]]]:
    """Points and edges (pairs of point numbers) of segments (n x 4) split wherever they meet."""
    a, d = segments[:, :2], segments[:, 2:] - segments[:, :2]
    length = np.hypot(d[:, 0], d[:, 1])
    keep = length > SNAP
    a, d, length = a[keep], d[keep], length[keep]
    at: list[list[float]] = [[0.0, 1.0] for _ in a]
    for i in range(len(a)):
        rest = np.arange(i + 1, len(a))
        w = a[rest] - a[i]
        cross = d[i, 0] * d[rest, 1] - d[i, 1] * d[rest, 0]
        slanted = np.abs(cross) > 1e-12 * length[i] * length[rest]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * d[rest, 1] - w[:, 1] * d[rest, 0]) / cross
            u = (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / cross
        et, eu = SNAP / length[i], SNAP / length[rest]
        met = slanted & (t >= -et) & (t <= 1 + et) & (u >= -eu) & (u <= 1 + eu)
        for k in np.flatnonzero(met):
            at[i].append(float(t[k]))
            at[rest[k]].append(float(u[k]))
        # lines along each other are split at each other's ends
        for k in rest[~slanted]:
            if abs(d[i, 0] * (a[k] - a[i])[1] - d[i, 1] * (a[k] - a[i])[0]) <= SNAP * length[i]:
                for p in (a[k], a[k] + d[k]):
                    at[i].append(float((p - a[i]) @ d[i]) / length[i] ** 2)
                for p in (a[i], a[i] + d[i]):
                    at[k].append(float((p - a[k]) @ d[k]) / length[k] ** 2)
    vertices, edges = Vertices(), set()
    for i, places in enumerate(at):
        ends = {0.0: a[i], 1.0: a[i] + d[i]}
        inner = sorted({min(1.0, max(0.0, t)) for t in places})
        numbers = [vertices.number(*map(float, ends[t] if t in ends else a[i] + t * d[i])) for t in inner]
        edges |= {(min(p, q), max(p, q)) for p, q in zip(numbers, numbers[1:]) if p != q}
    return vertices.points, edges


def _area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T  # the first corner is 0, so that the closing edge adds nothing
    return 0.5 * float(x[:-1] @ y[1:] - x[1:] @ y[:-1])


def _faces(points: list[tuple[float, float]], edges: set[tuple[int, int]]) -> list[list[int]]:
    """Borders of all faces, to their left; edges with the same face on both sides are left out."""
    edges = set(edges)
    while True:
        around: dict[int, list[int]] = {}
        for p, q in edges:
            around.setdefault(p, []).append(q)
            around.setdefault(q, []).append(p)
        ends = [(p, around[p][0]) for p in around if len(around[p]) == 1]
        if ends:
            edges -= {(min(e), max(e)) for e in ends}
            continue
        after: dict[tuple[int, int], int] = {}
        for p, others in around.items():
            others.sort(key=lambda q: math.atan2(points[q][1] - points[p][1], points[q][0] - points[p][0]))
            for k, q in enumerate(others):
                after[q, p] = others[k - 1]
        faces, face_of = [], {}
        for start in after:
            if start in face_of:
                continue
            border, edge = [], start
            while edge not in face_of:
                face_of[edge] = len(faces)
                border.append(edge[0])
                edge = (edge[1], after[edge])
            faces.append(border)
        same = {(p, q) for p, q in edges if face_of[p, q] == face_of[q, p]}
        if not same:
            return faces
        edges -= same


def within(point: tuple[float, float], ring: np.ndarray) -> int:
    """1 inside an open ring, 0 on it, -1 outside."""
    a, b = ring, np.roll(ring, -1, axis=0)
    d, w = b - a, np.asarray(point) - a
    t = np.clip((w * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
    if np.hypot(*(w - t[:, None] * d).T).min() <= ON:
        return 0
    up = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    left = d[:, 0] * w[:, 1] - d[:, 1] * w[:, 0] > 0
    return 1 if (up & (left == (b[:, 1] > a[:, 1]))).sum() % 2 else -1


def _inner_point(rings: list[np.ndarray]) -> tuple[float, float]:
    """A point inside: the middle of the widest stretch of a level line between corners' heights."""
    ys = np.unique(np.concatenate([r[:, 1] for r in rings]))
    gap = int(np.diff(ys).argmax())
    y = (ys[gap] + ys[gap + 1]) / 2
    xs = []
    for r in rings:
        a, b = r, np.roll(r, -1, axis=0)
        up = (a[:, 1] > y) != (b[:, 1] > y)
        xs.extend(a[up, 0] + (y - a[up, 1]) * (b[up, 0] - a[up, 0]) / (b[up, 1] - a[up, 1]))
    xs = np.sort(xs)
    widths = xs[1::2] - xs[::2]
    k = int(widths.argmax())
    return float(xs[2 * k] + widths[k] / 2), float(y)


def pieces(ring: np.ndarray, lines: np.ndarray) -> list[list[np.ndarray]]:
    """Pieces of the open ring (n x 2) cut by lines (m x 4): rings, first the outer one."""
    border = np.column_stack([ring, np.roll(ring, -1, axis=0)])
    origin = ring.mean(axis=0)  # near the cell, so that no digits are lost
    points, edges = noded(np.concatenate([border, lines.reshape(-1, 4)]) - np.tile(origin, 2))
    at = np.array(points).reshape(-1, 2)
    faces = [at[f] for f in _faces(points, edges)]
    areas = [_area(f) for f in faces]
    outer = [[f] for f, s in zip(faces, areas) if s > 0]
    for hole in (f for f, s in zip(faces, areas) if s < 0):
        around = [p for p in outer if _area(p[0]) > -_area(hole) + SNAP**2 and all(within(tuple(v), p[0]) >= 0 for v in hole)]
        around = [p for p in around if any(within(tuple(v), p[0]) > 0 for v in hole)]
        if around:
            min(around, key=lambda p: _area(p[0])).append(hole)
    cell = ring - origin
    return [[r + origin for r in p] for p in outer if within(_inner_point(p), cell) >= 0]


def covers(rings: list[np.ndarray], point: tuple[float, float]) -> bool:
    return within(point, rings[0]) >= 0 and all(within(point, r) <= 0 for r in rings[1:])


def piece_area(rings: list[np.ndarray]) -> float:
    return abs(_area(rings[0])) - sum(abs(_area(r)) for r in rings[1:])


def _apart(rings: list[np.ndarray], point: tuple[float, float]) -> float:
    out = math.inf
    for r in rings:
        d = np.roll(r, -1, axis=0) - r
        w = np.asarray(point) - r
        t = np.clip((w * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
        out = min(out, float(np.hypot(*(w - t[:, None] * d).T).min()))
    return out


def cut_through(ring: np.ndarray, lines: np.ndarray, site: tuple[float, float]) -> np.ndarray | None:
    """The part of a convex ring with the site, if all lines that meet the ring lead right
    through it and the site is off them: it lies on the site's side of each. Else None."""
    x, y, d = ring[:, 0], ring[:, 1], np.concatenate([ring[1:], ring[:1]]) - ring
    after = np.concatenate([d[1:], d[:1]])
    turns = d[:, 0] * after[:, 1] - d[:, 1] * after[:, 0]
    way, length = (1.0 if turns.sum() > 0 else -1.0), np.hypot(d[:, 0], d[:, 1])
    if len(ring) < 3 or (turns * way).min() <= 0 or way * _area(ring) <= 0 or length.min() <= SNAP:
        return None
    inward = lambda px, py: way * (d[:, 0] * (np.reshape(py, (-1, 1)) - y) - d[:, 1] * (np.reshape(px, (-1, 1)) - x)) / length
    a, b = inward(lines[:, 0], lines[:, 1]), inward(lines[:, 2], lines[:, 3])
    if inward(*site).min() <= SNAP or max(a.min(axis=1).max(), b.min(axis=1).max()) > -SNAP:
        return None  # a site or an end that is not clearly inside or outside
    for i in np.flatnonzero(~((a < 0) & (b < 0)).any(axis=1)):
        at = a[i] / np.where(a[i] == b[i], 1.0, a[i] - b[i])
        if at[a[i] < 0].max() >= at[b[i] < 0].min():
            continue  # passes a corner
        ux, uy = lines[i, 2] - lines[i, 0], lines[i, 3] - lines[i, 1]
        side = lambda px, py, i=i, ux=ux, uy=uy: (ux * (py - lines[i, 1]) - uy * (px - lines[i, 0])) / math.hypot(ux, uy)
        own = side(*site)
        v = side(ring[:, 0], ring[:, 1]) * math.copysign(1.0, own)
        if abs(own) <= SNAP or (np.abs(v) <= SNAP).any():
            return None
        out = []
        for k, (here, there) in enumerate(zip(v, np.concatenate([v[1:], v[:1]]))):
            if here > 0:
                out.append(ring[k])
            if (here > 0) != (there > 0):
                out.append(ring[k] + here / (here - there) * (ring[(k + 1) % len(ring)] - ring[k]))
        ring = np.array(out)
    return ring


def piece_of_site(ring: np.ndarray, lines: np.ndarray, site: tuple[float, float]) -> list[np.ndarray]:
    """The piece that holds the site, of several the largest; else the nearest one. A cell
    that no line divides stays as it is."""
    if not len(lines):
        return [ring]
    through = cut_through(ring, lines, site)
    if through is not None:
        return [through]
    found = pieces(ring, lines)
    if len(found) < 2:
        return [ring]
    holding = [p for p in found if covers(p, site)]
    if len(holding) == 1:
        return holding[0]
    return max(holding, key=piece_area) if holding else min(found, key=lambda p: _apart(p, site))
