"""Helpers that the training-data operators have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.session import forget, shared_folder, written
from plotline.spread import HOT_ROWS, join_spread, numbered

__all__ = ["HOT_ROWS", "balanced_sample", "fold", "forget", "held_out", "join_spread", "labelled_sample", "numbered", "shared_folder", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4


def held_out(doc_id: Column) -> Column:
    """Rows no label is learnt from; a null id counts as not held out, though it is not learnt from either."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def _sampled(narrow: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> list:
    """Rows (_id, _tie, _y, _text) for the (_id, _tie, _y) of ``narrow``, a bounded sample;
    repeated rows count once."""
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tie"), F.col(text_col).alias("_text"))
    found = texts.join(F.broadcast(narrow), ["_id", "_tie"]).groupBy("_id", "_tie", "_y").agg(F.first("_text").alias("_text"))
    return sorted(((r["_id"], r["_text"], r["_y"]) for r in found.collect()), key=lambda r: (r[0], r[1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list:
    """At most ``rows`` labelled training documents, as (doc_id, text, label) rows.

    Of all rows that have an id, a text and a label and are not held out, those with the
    smallest hash of id and text are drawn: random, repeatable and of bounded size. A
    document is one (id, text); an id whose label rows disagree has no label. Texts of
    any length are taken whole.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y"))
    known = known.where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (fold(F.col("_id")) != 2))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_most")).where("_y = _most").drop("_most")
    narrow = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 2))
    narrow = narrow.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tie")).distinct()
    drawn = narrow.join(known, "_id").orderBy(F.xxhash64("_id", "_tie"), "_id", "_tie").limit(rows)
    return _sampled(written(drawn, "drawn"), docs, "doc_id", "text")


def balanced_sample(docs: DataFrame, label: str, rows: int) -> list:
    """At most ``rows`` training documents as (doc_id, text, label) rows, with as many of
    each label as there are, up to an equal share; what rare ones leave goes to the others.

    As ``labelled_sample``, but that the label is a column of ``docs``; rows of one id and
    text whose labels disagree are not used.
    """
    narrow = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 2))
    narrow = narrow.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tie"), F.col(label).alias("_y"))
    narrow = narrow.groupBy("_id", "_tie").agg(F.min("_y").alias("_y"), F.max("_y").alias("_most")).where("_y = _most").drop("_most")
    order = (F.xxhash64("_id", "_tie"), F.col("_id"), F.col("_tie"))
    # of each label no task passes on more than ``rows``
    placed = narrow.withColumn("_n", F.row_number().over(Window.partitionBy("_y").orderBy(*order))).where(F.col("_n") <= rows)
    drawn = placed.orderBy("_n", *order).limit(rows).drop("_n")
    return _sampled(written(drawn, "drawn"), docs, "doc_id", "text")
