"""Spatial joins as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.geometry import box


def with_box(df: DataFrame, prefix: str, x: str, y: str, margin: float = 0.0) -> DataFrame:
    """Box columns of a point, widened by ``margin``."""
    return df.withColumns(
        {f"{prefix}xmin": F.col(x) - margin, f"{prefix}ymin": F.col(y) - margin, f"{prefix}xmax": F.col(x) + margin, f"{prefix}ymax": F.col(y) + margin}
    )


def _cells(df: DataFrame, prefix: str, size: float) -> DataFrame:
    x0, y0, x1, y1 = (F.floor(c / size).cast("long") for c in box(prefix))
    return df.withColumn("_gx", F.explode(F.sequence(x0, x1))).withColumn("_gy", F.explode(F.sequence(y0, y1)))


def grid_join(left: DataFrame, right: DataFrame, lp: str, rp: str, size: float, predicate: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs of rows whose boxes (columns with prefixes ``lp`` and ``rp``) meet and fulfil
    ``predicate``.

    Both sides are dealt to the grid cells that their boxes touch and joined on the cell.
    A pair that meets in several cells is kept in the one that holds the lower left
    corner of the boxes' intersection, so that no shuffle is needed to make pairs
    distinct. ``size`` should be near the usual side of a box; rows with a null box
    never match.
    """
    a, b = _cells(left, lp, size), _cells(right, rp, size).withColumnsRenamed({"_gx": "_hx", "_gy": "_hy"})
    ax0, ay0, ax1, ay1 = box(lp)
    bx0, by0, bx1, by1 = box(rp)
    meet = (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)
    corner = (F.col("_gx") == F.floor(F.greatest(ax0, bx0) / size)) & (F.col("_gy") == F.floor(F.greatest(ay0, by0) / size))
    joined = a.join(b, (F.col("_gx") == F.col("_hx")) & (F.col("_gy") == F.col("_hy")) & corner & meet)
    if predicate is not None:
        joined = joined.where(predicate)
    return joined.drop("_gx", "_gy", "_hx", "_hy")
