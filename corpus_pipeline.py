"""A corpus pipeline of five stages, each a Spark job on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.llm import decontaminate, mixing, secrets, simhash, toxicity
from plotline.llm.queries import TOXIC_FROM
from plotline.llm.shared import forget, table, written
from plotline.session import scratch


def _blob(docs: DataFrame) -> Column:
    """The hash of a row's text, null as if empty. With the id it names a row: ids may be
    null or repeated with other texts."""
    return F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)


def _order(docs: DataFrame) -> Column:
    """An order of rows with equal id and text, so that reruns agree; maps have none."""
    return F.struct(F.col("text").isNull().alias("bare"), *[c for c, kind in docs.dtypes if c != "text" and "map<" not in kind])


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` but for the texts whose hash is in ``rejected`` (_row), for decisions that
    follow from the text alone."""
    rejected = rejected.select(F.col("_row").alias("_rejected")).distinct()
    return docs.join(rejected, _blob(docs) == rejected["_rejected"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts, in the columns they came in; each row is
    judged by its own text."""
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scores = toxicity.score_toxicity(docs.select(_blob(docs).alias("_row"), "text"), model, id_col="_row")
    return _without(docs, scores.where(F.col("score") >= TOXIC_FROM))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id, and of rows with that
    id the one with the smallest text hash. A row without an id stays only where no row of
    the component has one. Of rows that repeat id and text one stays, by the other columns."""
    lacks = F.when(docs["doc_id"].isNull(), True)  # null, which comes first, where there is an id
    keyed = docs.withColumn("_row", F.struct(lacks.alias("lacks"), docs["doc_id"].alias("id"), _blob(docs).alias("blob")))
    found = simhash.near_duplicates(keyed, id_col="_row")
    kept = found.where(F.col("_row") == F.col("component_id")).select(F.col("_row").alias("_kept")).distinct()
    rows = keyed.join(kept, F.col("_row") == F.col("_kept"), "left_semi")
    return rows.groupBy("_row").agg(F.min_by(F.struct(*docs.columns), _order(docs)).alias("_one")).select("_one.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, each row by its own text."""
    found = decontaminate.decontaminate(docs.select(_blob(docs).alias("_row"), "text"), table(spark, sf_dir, "benchmark"), id_col="_row")
    return _without(docs, found.where("contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by their kind; n_chars follows."""
    scans = written(secrets.scan_secrets(docs), "scans")
    # rows of one id are told apart by their blobs; those without a finding stay as they are
    found = scans.where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    found = found.dropDuplicates(["_id", "_blob"])
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (_blob(docs) == found["_blob"]), "left")
    spans = found["_spans"]
    text = F.when(spans.isNotNull(), secrets.redacted(docs["text"], spans)).otherwise(docs["text"])
    changed = {"text": text, "n_chars": F.when(spans.isNotNull(), F.length(text).cast("long")).otherwise(docs["n_chars"])}
    return joined.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``size`` in words and ``copies``, how often
    each is taken. Rows of equal id, source and text are taken as often as the mix takes
    of such rows, the first ones by the other columns where it does not take all alike."""
    mixed = mixing.mix_rows(docs).where("size > 0")
    times = F.col("taken") / F.col("size")
    laps = range(1, mixing.PASSES + 1)
    rows_of = [F.sum(F.when(times >= lap, 1).otherwise(0)).alias(f"_rows{lap}") for lap in laps]
    mixed = mixed.groupBy(F.struct(F.col("doc_id").alias("id"), F.col("_source").alias("source"), F.col("_tie").alias("tie")).alias("_taken")).agg(F.max("size").alias("_size"), *rows_of)
    keyed = docs.withColumn("_row", F.struct(docs["doc_id"].alias("id"), docs["source"].alias("source"), F.xxhash64(docs["text"]).alias("tie")))
    joined = keyed.join(mixed.where("_rows1 > 0"), F.col("_row") == F.col("_taken"))
    place = F.row_number().over(Window.partitionBy("_row").orderBy(_order(docs)))
    joined = joined.withColumn("_place", place)
    copies = sum((F.when(F.col("_place") <= F.col(f"_rows{lap}"), 1).otherwise(0) for lap in laps), F.lit(0)).cast("long")
    own = [c for c in docs.columns if c not in ("size", "copies")]
    return joined.select(*own, F.col("_size").alias("size"), copies.alias("copies")).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix),
]

#: SQL can't state the trained classifier of the first stage; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written and read again. What a stage
    writes on the way, and what its predecessor kept, is deleted once its result is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            kept = written(stage(spark, docs, sf_dir), name, keep=True)
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
