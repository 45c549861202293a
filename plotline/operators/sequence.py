"""House numbers along the sides of chains: out of sequence, or of the wrong parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.operators.quality import MIN_GAP, MIN_PARITY_SIDE, MIN_SIDE, PARITY_SHARE

SIDE = ("key", "chain", "side")


def without_stray_heads(placed: DataFrame) -> DataFrame:
    """Sides without the addresses at a street's head whose parity nearly all others lack."""
    side = Window.partitionBy(*SIDE)
    rest = placed.withColumns(
        {"_others": F.count_if(~F.col("head")).over(side), "_even": F.count_if(~F.col("head") & (F.col("house") % 2 == 0)).over(side)}
    )
    against = F.when(F.col("house") % 2 == 0, F.col("_others") - F.col("_even")).otherwise(F.col("_even"))
    stray = F.col("head") & (F.col("_others") > 0) & (against >= PARITY_SHARE * F.col("_others"))
    return rest.where(~stray).drop("_others", "_even")


def out_of_sequence(placed: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Numbers that are not between their two neighbours though these are in the street's
    order, and clearly apart from the one they disagree with. The order is the net
    direction of both sides, or of the side if that is none. Rows beside a bulb count as
    neighbours but are not reported, nor is anything but ``subjects`` (id)."""
    rows = without_stray_heads(placed)
    side, order = Window.partitionBy(*SIDE), Window.partitionBy(*SIDE).orderBy("at", "id")
    rows = rows.withColumns({f"_{c}0": F.lag(c).over(order) for c in ("id", "house", "at", "low", "high")} | {f"_{c}1": F.lead(c).over(order) for c in ("id", "house", "at", "low", "high")})
    rows = rows.withColumn("_step", F.coalesce(F.signum(F.col("house") - F.col("_house0")), F.lit(0.0)))
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(side), "_own": F.sum("_step").over(side), "_net": F.sum("_step").over(Window.partitionBy("key", "chain"))})
    rows = rows.withColumn("dir", F.when(F.col("_net") != 0, F.signum("_net")).otherwise(F.signum("_own")))

    def apart(end: str):
        far = F.round(F.abs(F.col("at") - F.col(f"_at{end}")), 9) >= MIN_GAP
        covers = F.col(f"_at{end}").between(F.col("low"), F.col("high")) | F.col("at").between(F.col(f"_low{end}"), F.col(f"_high{end}"))
        return far & ~covers

    a, b, c = (F.col("dir") * F.col(x) for x in ("_house0", "house", "_house1"))
    wrong = (a < c) & (((b < a) & apart("0")) | ((b > c) & apart("1")))
    out = rows.where((F.col("n") >= MIN_SIDE) & (F.col("dir") != 0) & ~F.col("loop") & wrong).select("id", "key", "chain", "side", "house", F.col("_house0").alias("before"), F.col("_house1").alias("after"), F.col("_id0").alias("before_id"), F.col("_id1").alias("after_id"))
    return out if subjects is None else out.join(subjects.select("id"), "id", "left_semi")


def wrong_parity(placed: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Numbers whose parity is not that of nearly all numbers on their side, bulbs left out."""
    rows = without_stray_heads(placed).where(~F.col("loop"))
    side = Window.partitionBy(*SIDE)
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(side), "even": F.count_if(F.col("house") % 2 == 0).over(side)})
    usual = F.when(F.col("even") >= PARITY_SHARE * F.col("n"), 0).when(F.col("n") - F.col("even") >= PARITY_SHARE * F.col("n"), 1)
    out = rows.where((F.col("n") >= MIN_PARITY_SIDE) & usual.isNotNull() & (F.col("house") % 2 != usual)).select("id", "key", "chain", "side", "house")
    return out if subjects is None else out.join(subjects.select("id"), "id", "left_semi")
