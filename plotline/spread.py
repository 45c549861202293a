"""Joins and numberings that no single key or task can hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.session import written

#: A key of more rows than this is hot; so there is at most one hot key for so many rows.
HOT_ROWS = 200_000
#: Spark may broadcast what comes from files of fewer bytes than this.
BROADCAST_BYTES = 128 * 1024


def joined_by_shuffle(df: DataFrame, path: str) -> DataFrame:
    """``df``, read from ``path``, for joins: unless the files are small, it is not broadcast.

    Spark guesses from the size of the files whether a table fits the driver; packed columns and
    polygons take many times as much memory there. An explicit ``F.broadcast`` still holds.
    """
    spark: SparkSession = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return df.hint("merge") if size > BROADCAST_BYTES else df


def stored(df: DataFrame, label: str) -> DataFrame:
    """``written``, for tables that grow with the input."""
    table = written(df, label)
    out = joined_by_shuffle(table, table.written_path)
    out.written_path = table.written_path  # type: ignore[attr-defined]
    return out


def dealt(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """``df`` dealt by keys to as many tasks as a shuffle has, and at least ``least``, for Python that takes long for
    few bytes: Spark would put small partitions together, up to one task for all rows. By
    their hash, as Spark leaves out a shuffle by the keys of the join before it."""
    spark: SparkSession = df.sparkSession
    return df.repartition(max(least, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(*keys))


def numbered(rows: DataFrame, *order: Column | str, at_once: int = HOT_ROWS) -> DataFrame:
    """``rows`` with ``_n``, their places in the order from 0. More than ``at_once`` rows
    are numbered within ranges, and the few ranges' sizes are added up."""
    if rows.count() <= at_once:
        return rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)) - 1)
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))  # a row for each range
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = ranged.withColumn("_own", own).join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return placed.withColumn("_n", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")


def join_spread(rows: DataFrame, unique: DataFrame, key: str, how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined to ``unique``, which has one row a key, null keys matching nothing.

    Rows of hot keys stay where they are: their rows of ``unique``, at most one for each
    ``hot_rows`` rows, are broadcast. The others are shuffled. ``rows`` is read three
    times, so it should be a written table.
    """
    hot = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > hot_rows).select("_hot")
    hot = written(hot, "hot-keys")
    if not hot.take(1):
        return rows.join(unique, key, how)
    theirs = unique.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_semi")
    here = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_semi")
    rest = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_anti")
    return here.join(F.broadcast(theirs), key, how).unionByName(rest.join(unique, key, how))
