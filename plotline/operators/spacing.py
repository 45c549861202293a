"""Nearest sites, local spacing, trimmed nearest-site cells and the search for a parcel shift."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.geometry import in_polygon
from plotline.functions.shapes import shape_columns
from plotline.operators.arrangement import piece_area, piece_of_site
from plotline.operators.grid import grid_join, with_box
from plotline.session import ship
from plotline.spread import dealt, numbered, stored

NEAR = 8
AROUND = 10
MIN_SPACING = 1.0
CORNERS = 32
# Fixed values of the shift estimate.
LEAST_SAMPLES, CHANGED = 5, 0.01
SIGNIFICANT_SAMPLES, SIGNIFICANT_SHIFT, SIGNIFICANT_GAIN, SIGNIFICANT_RATIO, SIGNIFICANT_IMPROVED = 20, 1.5, 0.02, 3, 5
#: So few points may be compared with all sites, if the pairs are few too, or the points far from everything.
FAR_POINTS, FAR_PAIRS, FAR_ROUNDS = 1000, 2_000_000, 8


def _finite(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    return df


def nearest_sites(points: DataFrame, sites: DataFrame, k: int, radius: float) -> DataFrame:
    """For each point (pid, px, py) its ``k`` nearest sites (sid, sx, sy) with rank and distance.

    Points that find fewer within ``radius`` are tried again with twice the radius, until
    all have k, or all sites; each round only those are left that still lack some. The
    last FAR_POINTS, which lie far from everything, are compared with all sites, each task
    of which passes on k for a point. Points and sites without finite coordinates take
    no part.
    """
    points, sites = _finite(points, "px", "py"), stored(_finite(sites, "sx", "sy"), "sites")
    many = sites.count()
    need, out = min(k, many), None
    left = stored(points, "points")
    nothing = points.select("pid", F.lit(0).cast("long").alias("sid"), F.lit(0).alias("rank"), F.lit(0.0).alias("distance")).limit(0)
    waiting = left.count() if need else 0
    apart = F.sqrt(F.pow(F.col("px") - F.col("sx"), 2) + F.pow(F.col("py") - F.col("sy"), 2))
    nearest = Window.partitionBy("pid").orderBy("distance", "sid")
    rounds = 0
    while waiting:
        if rounds and waiting <= FAR_POINTS and (waiting * many <= FAR_PAIRS or rounds >= FAR_ROUNDS):
            spread = sites.repartition(int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid")
            pairs = spread.crossJoin(F.broadcast(left)).select("pid", "sid", apart.alias("distance"))
            last = pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= need).select("pid", "sid", "rank", "distance")
            return last if out is None else out.unionByName(last)
        pairs = grid_join(with_box(left, "a", "px", "py", radius), with_box(sites, "s", "sx", "sy"), "a", "s", radius)
        pairs = pairs.select("pid", "sid", apart.alias("distance")).where(F.col("distance") <= radius)
        ranked = pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= need)
        ranked = stored(ranked.withColumn("_found", F.max("rank").over(Window.partitionBy("pid"))), "nearest")
        done = ranked.where(F.col("_found") == need).select("pid", "sid", "rank", "distance")
        out = done if out is None else out.unionByName(done)
        left = stored(left.join(done.where("rank = 1").select(F.col("pid").alias("_f")), F.col("pid") == F.col("_f"), "left_anti"), "left")
        waiting, rounds = left.count(), rounds + 1
        radius *= 2
    return nothing if out is None else out


def local_spacing(sites: DataFrame, radius: float = 60.0) -> DataFrame:
    """Spacing at each site (sid, sx, sy): the median, over the nearest AROUND sites, of
    their distance to the nearest other site at least a metre away; the overall median
    where none of them has one. Sites at the same place count once."""
    distinct = stored(sites.groupBy("sx", "sy").agg(F.min("sid").alias("sid")), "sites")
    points = distinct.select(F.col("sid").alias("pid"), F.col("sx").alias("px"), F.col("sy").alias("py"))
    near = stored(nearest_sites(points, distinct, max(NEAR, AROUND), radius), "near")
    gaps = near.where((F.col("rank") <= NEAR) & (F.col("distance") >= MIN_SPACING)).groupBy(F.col("pid").alias("_s")).agg(F.min("distance").alias("gap"))
    gaps = stored(gaps, "gaps")
    around = near.where(F.col("rank") <= AROUND).join(gaps, F.col("sid") == F.col("_s"), "left")
    overall = gaps.agg(F.median("gap").alias("_all"))  # one row
    return around.groupBy("pid").agg(F.median("gap").alias("own")).crossJoin(F.broadcast(overall)).select(F.col("pid").alias("sid"), F.coalesce("own", "_all").alias("spacing"))


def clip_to_nearer(ring: np.ndarray, site: tuple[float, float], other: tuple[float, float]) -> np.ndarray:
    """The part of a convex ring (n x 2, open) that is nearer to ``site`` than to ``other``."""
    nx, ny = other[0] - site[0], other[1] - site[1]
    limit = (other[0] ** 2 + other[1] ** 2 - site[0] ** 2 - site[1] ** 2) / 2
    value = ring[:, 0] * nx + ring[:, 1] * ny - limit
    if (value <= 0).all():
        return ring
    out = []
    for i in range(len(ring)):
        j = (i + 1) % len(ring)
        if value[i] <= 0:
            out.append(ring[i])
        if (value[i] < 0 < value[j]) or (value[j] < 0 < value[i]):
            t = value[i] / (value[i] - value[j])
            out.append(ring[i] + t * (ring[j] - ring[i]))
    return np.array(out).reshape(-1, 2)


def site_cells(sites: DataFrame, reach: DataFrame) -> DataFrame:
    """Cells of sites (sid, sx, sy): what is nearest to the site within its reach (sid, reach),
    as a ring and its area.

    A cell starts as a 32-gon and loses what is nearer to another site. Only sites within
    twice the reach can take anything away, so each cell is made from its own
    neighbourhood, in a task of its own group of rows.
    """
    ship(sites.sparkSession)
    rows = sites.join(reach.withColumnRenamed("sid", "_s"), F.col("sid") == F.col("_s")).drop("_s")
    rows = rows.withColumns({"axmin": F.col("sx") - 2 * F.col("reach"), "aymin": F.col("sy") - 2 * F.col("reach"), "axmax": F.col("sx") + 2 * F.col("reach"), "aymax": F.col("sy") + 2 * F.col("reach")})
    others = with_box(sites.select(F.col("sid").alias("oid"), F.col("sx").alias("ox"), F.col("sy").alias("oy")), "o", "ox", "oy")
    pairs = grid_join(rows, others, "a", "o", 60.0, F.col("oid") != F.col("sid"))
    apart = F.pow(F.col("ox") - F.col("sx"), 2) + F.pow(F.col("oy") - F.col("sy"), 2)
    near = pairs.groupBy(F.col("sid").alias("_n")).agg(F.array_sort(F.collect_list(F.struct(apart.alias("apart"), "oid", "ox", "oy"))).alias("near"))
    full = rows.select("sid", "sx", "sy", "reach").join(near, F.col("sid") == F.col("_n"), "left").select(
        "sid", "sx", "sy", "reach", F.transform("near", lambda n: n["ox"]).alias("xs"), F.transform("near", lambda n: n["oy"]).alias("ys")
    )
    angle = np.arange(CORNERS) * (2 * math.pi / CORNERS)

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                ring = np.column_stack([row.sx + row.reach * np.cos(angle), row.sy + row.reach * np.sin(angle)])
                widest, cut_by = row.reach**2, ring
                for x, y in zip(row.xs if row.xs is not None else (), row.ys if row.ys is not None else ()):
                    if not len(ring) or (x - row.sx) ** 2 + (y - row.sy) ** 2 > 4.000001 * widest:
                        break  # nearest first: this one and all others are too far from any corner
                    if (x, y) != (row.sx, row.sy):
                        ring = clip_to_nearer(ring, (row.sx, row.sy), (x, y))
                    if ring is not cut_by and len(ring):
                        widest, cut_by = float(((ring[:, 0] - row.sx) ** 2 + (ring[:, 1] - row.sy) ** 2).max()), ring
                area = 0.5 * abs(float(np.sum(ring[:, 0] * np.roll(ring[:, 1], -1) - np.roll(ring[:, 0], -1) * ring[:, 1]))) if len(ring) else 0.0
                out.append((row.sid, area, [{"x": float(x), "y": float(y)} for x, y in ring]))
            yield pd.DataFrame(out, columns=["sid", "area", "ring"])

    return dealt(full, "sid").mapInPandas(cut, "sid long, area double, ring array<struct<x:double,y:double>>")


def road_clipped(cells: DataFrame, sites: DataFrame, roads: DataFrame) -> DataFrame:
    """Cells (sid, ring) cut along roads, given as straight pieces (ax, ay, bx, by): of each
    the part with its site (sid, sx, sy) stays, as ring, holes and area.

    Roads may bend, branch and end within a cell; what they do not cut off stays (see
    operators.arrangement). Of a site on a road the largest part beside it counts.
    """
    ship(cells.sparkSession)
    corner = lambda c: F.transform("ring", lambda p: p[c])
    rows = cells.where(F.size("ring") > 2).join(sites.select(F.col("sid").alias("_s"), "sx", "sy"), F.col("sid") == F.col("_s")).drop("_s")
    boxed = rows.withColumns({"cxmin": F.array_min(corner("x")), "cymin": F.array_min(corner("y")), "cxmax": F.array_max(corner("x")), "cymax": F.array_max(corner("y"))})
    lines = roads.select("ax", "ay", "bx", "by").withColumns({"rxmin": F.least("ax", "bx"), "rymin": F.least("ay", "by"), "rxmax": F.greatest("ax", "bx"), "rymax": F.greatest("ay", "by")})
    near = grid_join(boxed.select("sid", "cxmin", "cymin", "cxmax", "cymax"), lines, "c", "r", 60.0).distinct()
    near = near.groupBy(F.col("sid").alias("_n")).agg(F.array_sort(F.collect_list(F.array("ax", "ay", "bx", "by"))).alias("lines"))  # a cell's own roads
    full = rows.join(near, F.col("sid") == F.col("_n"), "left").select("sid", "sx", "sy", corner("x").alias("xs"), corner("y").alias("ys"), "lines")

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                own = np.array([list(line) for line in row.lines] if row.lines is not None else [], float).reshape(-1, 4)
                rings = piece_of_site(np.column_stack([row.xs, row.ys]), own, (row.sx, row.sy))
                shown = [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]
                out.append((row.sid, piece_area(rings), shown[0], shown[1:]))
            yield pd.DataFrame(out, columns=["sid", "area", "ring", "holes"])

    point = "struct<x:double,y:double>"
    return dealt(full, "sid").mapInPandas(cut, f"sid long, area double, ring array<{point}>, holes array<array<{point}>>")


def even_sample(rows: DataFrame, order: str, most: int) -> DataFrame:
    """At most about ``most`` rows, evenly over the order: 0, step, 2 step and so on."""
    step = max(1.0, rows.count() / most)
    placed = numbered(rows, order)
    return placed.where(F.col("_n") == F.floor(F.ceil(F.col("_n") / step) * step)).drop("_n")


def _held(samples: DataFrame, parcels: DataFrame, shifts: DataFrame) -> DataFrame:
    """For each offset and building the most outline points that one parcel holds."""
    reach = 14.0
    shape = shape_columns(parcels, "c")
    near = grid_join(with_box(samples, "p", "x", "y", reach), parcels.select("cell_id", *shape), "p", "c", 40.0).select("bid", "x", "y", "cell_id", *shape)
    # a stated, small set of offsets against all points
    moved = near.crossJoin(F.broadcast(shifts)).where("x >= cxmin + dx AND x <= cxmax + dx AND y >= cymin + dy AND y <= cymax + dy")
    if "crings" in shape:
        moved = moved.where(in_polygon(F.col("x") - F.col("dx"), F.col("y") - F.col("dy"), F.col("crings")))
    return moved.groupBy("dx", "dy", "bid", "cell_id").agg(F.count(F.lit(1)).alias("n")).groupBy("dx", "dy", "bid").agg(F.max("n").alias("n"))


def shift_scores(samples: DataFrame, parcels: DataFrame, offsets: DataFrame) -> DataFrame:
    """For each offset (dx, dy) the mean, over buildings, of the largest share of the
    building's outline points (bid, x, y) that one parcel moved by the offset holds."""
    sizes = samples.groupBy(F.col("bid").alias("_b")).agg(F.count(F.lit(1)).alias("points"))
    best = _held(samples, parcels, offsets).join(sizes, F.col("bid") == F.col("_b"))
    total = sizes.agg(F.count(F.lit(1)).alias("_t"))  # one row
    return best.groupBy("dx", "dy").agg(F.sum(F.col("n") / F.col("points")).alias("s")).crossJoin(F.broadcast(total)).select("dx", "dy", (F.col("s") / F.col("_t")).alias("score"))


def offsets(spark, dx: float, dy: float, reach: float, step: float, limit: float = 12.0) -> DataFrame:
    n = round(2 * reach / step) + 1
    grid = spark.range(n * n).select((F.col("id") % n * step - reach + dx).alias("dx"), (F.floor(F.col("id") / n) * step - reach + dy).alias("dy"))
    return grid.where((F.abs("dx") <= limit) & (F.abs("dy") <= limit))


def _shares(samples: DataFrame, parcels: DataFrame, shifts: DataFrame) -> DataFrame:
    """For each offset (dx, dy) and building, the largest share of its outline points that
    one parcel moved by the offset holds; 0 where none holds any."""
    held = _held(samples, parcels, shifts)
    sizes = samples.groupBy(F.col("bid").alias("_b")).agg(F.count(F.lit(1)).alias("points"))
    every = sizes.crossJoin(F.broadcast(shifts)).select(F.col("dx").alias("_dx"), F.col("dy").alias("_dy"), "_b", "points")
    found = every.join(held, (F.col("_b") == F.col("bid")) & (F.col("_dx") == F.col("dx")) & (F.col("_dy") == F.col("dy")), "left")
    return found.select(F.col("_dx").alias("dx"), F.col("_dy").alias("dy"), F.col("_b").alias("bid"), (F.coalesce("n", F.lit(0)) / F.col("points")).alias("share"))


def best_shift(samples: DataFrame, parcels: DataFrame) -> tuple[float, float]:
    """Coarse to fine: the offset of the best score, the smaller shift of equal ones. One
    row reaches the driver in each of the three rounds."""
    samples = stored(samples, "samples")
    x = y = 0.0
    for reach, step in ((12.0, 2.0), (2.0, 0.5), (0.5, 0.25)):
        scores = shift_scores(samples, parcels, offsets(samples.sparkSession, x, y, reach, step))
        top = scores.orderBy(F.desc(F.round("score", 9)), F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "dx", "dy").first()
        if top is None:
            return 0.0, 0.0
        x, y = top["dx"], top["dy"]
    return x, y


def shift_estimate(samples: DataFrame, parcels: DataFrame) -> DataFrame:
    """The shift of the parcels (dx, dy) with what speaks for it: samples, the mean share
    before and after, and how many buildings gain or lose more than a hundredth.

    Buildings of which no parcel holds anything at no shift say nothing and are left out;
    there is no row for fewer than five others. See SIGNIFICANT_* for when a shift is
    worth applying.
    """
    samples = stored(samples, "samples")
    here = offsets(samples.sparkSession, 0.0, 0.0, 0.0, 1.0)
    useful = stored(_shares(samples, parcels, here).where("share > 0").select(F.col("bid").alias("_u")), "useful")
    samples = stored(samples.join(useful, F.col("bid") == F.col("_u"), "left_semi"), "useful-samples")
    x, y = best_shift(samples, parcels)
    moved = here.select(F.lit(x).alias("dx"), F.lit(y).alias("dy"))
    before = _shares(samples, parcels, here).select(F.col("bid").alias("_b"), F.col("share").alias("before"))
    rows = _shares(samples, parcels, moved).join(before, F.col("bid") == F.col("_b")).withColumn("gain", F.round(F.col("share") - F.col("before"), 9))
    out = rows.agg(
        F.count(F.lit(1)).alias("samples"), F.avg("before").alias("before"), F.avg("share").alias("after"),
        F.count_if(F.col("gain") > CHANGED).alias("improved"), F.count_if(F.col("gain") < -CHANGED).alias("worsened"),
    ).where(F.col("samples") >= LEAST_SAMPLES)
    helps = (F.round(F.col("after") - F.col("before"), 9) >= SIGNIFICANT_GAIN) & (F.col("improved") >= SIGNIFICANT_RATIO * F.col("worsened")) & (F.col("improved") >= SIGNIFICANT_IMPROVED)
    significant = F.lit(math.hypot(x, y) >= SIGNIFICANT_SHIFT) & (F.col("samples") >= SIGNIFICANT_SAMPLES) & helps
    return out.select(F.lit(x).alias("dx"), F.lit(y).alias("dy"), "samples", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "improved", "worsened", significant.alias("significant"))
