"""Mixing sources to target weights by weighted fair queueing.

Every document of a source has a place in that source's shuffled queue and a virtual
finish time: the source's words up to it, divided by the source's target. All queues
are merged in the order of these times, and the merged sequence is cut where it
reaches the total budget. A source whose target exceeds its size is queued again, up
to PASSES times. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.shared import numbered, written

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
PASSES = 2
#: Rows that a running sum within one cell has on average.
CELL_ROWS = 2000
#: Ranges of finish times told apart at once while the cut is looked for.
SLOTS = 1024
#: What lies between words.
GAP = r"[\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """Target words of each source (_source, _size): its weight's share of ``budget``
    times all words, at most ``passes`` times its size, the excess reshared by weight.

    One row per source comes in and goes out. Sources are ranked by code point, null
    last, for the repeating weights. Resharing goes as it says: all open sources get one
    level of words for each unit of weight, those whose caps that exceeds are closed at
    their caps, until none is. A round is one aggregate, of which a row reaches the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    sized = numbered(sources, F.col("_source").isNull(), "_source").withColumn("_weight", weight).withColumn("_cap", F.lit(float(passes)) * F.col("_size"))
    sized = written(sized.select("_source", "_size", "_weight", "_cap"), "sources")
    words = budget * (sized.agg(F.sum("_size")).first()[0] or 0)
    level, closed = 0.0, -1
    while True:
        full = F.col("_cap") < F.col("_weight") * level
        now = sized.agg(
            F.count(F.when(full, 1)).alias("closed"), F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)).alias("open")
        ).first()
        if now["closed"] == closed or not now["open"]:
            break
        closed, level = now["closed"], (words - now["taken"]) / now["open"]
    target = F.least("_cap", F.col("_weight") * level) if now["open"] else F.col("_cap")
    return sized.select("_source", F.col("_size").alias("_source_size"), target.alias("_target"))


def _queue(sized: DataFrame, rows: int) -> DataFrame:
    """``_served``: the words of the row's source up to and with the row, in queue order.

    No task sees a whole source: sums run within cells of the queue (the leading bits of
    the place), over the cells of a coarse cell, and over the coarse cells of a source.
    """
    bits = min(40, max(0, math.ceil(math.log2(max(1, rows / CELL_ROWS)))))
    place = F.conv(F.substring("_place", 1, 10), 16, 10).cast("long")
    cells = sized.withColumn("_fine", F.shiftright(place, 40 - bits)).withColumn("_coarse", F.shiftright(place, 40 - bits // 2))
    fine = cells.groupBy("_source", "_coarse", "_fine").agg(F.sum("_size").alias("_sum"))
    coarse = fine.groupBy("_source", "_coarse").agg(F.sum("_sum").alias("_sum"))
    earlier = (Window.unboundedPreceding, -1)
    fine_before = F.sum("_sum").over(Window.partitionBy("_source", "_coarse").orderBy("_fine").rowsBetween(*earlier))
    coarse_before = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_coarse").rowsBetween(*earlier))
    fine = fine.select(F.col("_source").alias("_s1"), F.col("_fine").alias("_f1"), F.coalesce(fine_before, F.lit(0)).alias("_b1"))
    coarse = coarse.select(F.col("_source").alias("_s2"), F.col("_coarse").alias("_c2"), F.coalesce(coarse_before, F.lit(0)).alias("_b2"))
    own = Window.partitionBy("_source", "_fine").orderBy("_place", "_id", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return (
        cells.withColumn("_own", F.sum("_size").over(own))
        .join(written(fine, "cells"), F.col("_source").eqNullSafe(F.col("_s1")) & (F.col("_fine") == F.col("_f1")))
        .join(written(coarse, "coarse"), F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_coarse") == F.col("_c2")))
        .withColumn("_served", F.col("_own") + F.col("_b1") + F.col("_b2"))
    )


def _order_key(finish: Column) -> Column:
    """Place of a row in the merged sequence; equal times follow the sources' order."""
    return F.struct(
        finish.alias("f"), F.col("_source").isNull().alias("n"), F.coalesce("_source", F.lit("")).alias("s"),
        F.col("_place").alias("p"), F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("i"), F.col("_tie").alias("t"),
    )


def _cut(merged: DataFrame, budget: float) -> dict | None:
    """Order key of the last row of the merged sequence within the budget.

    The range of times that holds the cut is divided into SLOTS again and again, until
    few enough rows are in it to be sorted; only one row a round reaches the driver.
    """
    low, high, before = 0.0, None, 0
    here, last = merged, None
    while True:
        stats = here.agg(F.count(F.lit(1)).alias("n"), F.max("_finish").alias("most")).first()
        if not stats["n"]:
            return last
        high = stats["most"] if high is None else high
        if stats["n"] <= 4 * CELL_ROWS or not high > low:
            break
        width = (high - low) / SLOTS
        if low + width <= low or high - width >= high:
            break
        slot = F.least(F.floor((F.col("_finish") - low) / width), F.lit(SLOTS - 1))
        sums = here.groupBy(slot.alias("_slot")).agg(F.sum("_size").alias("_sum"), F.max("_key").alias("_last"))
        # at most SLOTS rows
        running = sums.withColumn("_until", F.sum("_sum").over(Window.orderBy("_slot")) + before)
        whole = running.where(F.col("_until") <= budget).orderBy(F.desc("_slot")).first()
        over = running.where(F.col("_until") > budget).orderBy("_slot").first()
        if whole:
            last = whole["_last"]
        if over is None:
            return last
        before = over["_until"] - over["_sum"]
        here = here.where(slot == over["_slot"])
        low, high = low + over["_slot"] * width, (low + (over["_slot"] + 1) * width if over["_slot"] < SLOTS - 1 else high)
    until = F.sum("_size").over(Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)) + before
    fits = here.withColumn("_until", until).where(F.col("_until") <= budget).orderBy(F.desc("_until"), F.desc("_key")).first()
    return fits["_key"] if fits else last


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = WEIGHTS,
    budget: float = BUDGET,
    passes: int = PASSES,
) -> DataFrame:
    """Per document: id, size, source_size, target, taken, and first_finish, its finish
    time in its source's first pass (null where the source has no words).

    ``taken`` counts the words that the mix takes of the document, repeats included: 0,
    its size, or up to ``passes`` times its size. The queue order within a source is
    that of a hash of id and text, so that rows without an id, or of one id, are spread
    over it; full ties are the same row twice, of which either may come first. A null source
    is a source of its own, the last. Null and empty texts have size 0 and add nothing.
    An empty table gives an empty result. Other columns are not read.
    """
    return mix_rows(docs, id_col, text_col, source_col, weights, budget, passes).drop("_source", "_tie")


def mix_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = WEIGHTS,
    budget: float = BUDGET,
    passes: int = PASSES,
) -> DataFrame:
    """``mix_sources`` with the source and the text's xxhash64 of each row (_source, _tie)."""
    sized = written(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("_source"),
            F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), GAP), "")).cast("long").alias("_size"),
            F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary")).alias("_place"),
            F.xxhash64(text_col).alias("_tie"),
        ),
        "sized",
    )
    every = sized.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_size"), F.lit(0)).alias("words")).first()
    targets = written(source_targets(sized.groupBy("_source").agg(F.sum("_size").alias("_size")), weights, budget, passes), "targets")
    queued = _queue(sized, every["rows"]).join(
        targets.withColumnRenamed("_source", "_named"), F.col("_source").eqNullSafe(F.col("_named"))
    )
    queued = written(queued.select("_id", "_source", "_size", "_source_size", "_target", "_served", "_place", "_tie"), "queued")

    def finish(lap: Column | int) -> Column:
        words = F.lit(lap) * F.col("_source_size") + F.col("_served") if isinstance(lap, int) else lap * F.col("_source_size") + F.col("_served")
        return F.when(F.col("_target") > 0, words.cast("double") / F.col("_target"))

    merged = (
        queued.where("_size > 0")
        .withColumn("_lap", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        .withColumn("_finish", finish(F.col("_lap")))
        .select("_size", "_finish", _order_key(F.col("_finish")).alias("_key"))
    )
    last = _cut(merged, min(budget, float(passes)) * every["words"]) if every["words"] else None
    times = F.lit(0)
    if last is not None:
        cut = F.struct(*[F.lit(last[k]).alias(k) for k in ("f", "n", "s", "p", "i", "t")])
        for lap in range(passes):
            times = times + F.when(_order_key(finish(lap)) <= cut, 1).otherwise(0)
    return queued.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.when(F.col("_size") > 0, F.col("_size") * times).otherwise(0).cast("long").alias("taken"),
        finish(0).alias("first_finish"),
        "_source",
        "_tie",
    )
