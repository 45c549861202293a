import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from plotline.llm import decontaminate, simhash
from plotline.llm.shared import table


@pytest.fixture(scope="module")
def docs(spark, tiny):
    extra = [(None, None, None, None, None), (9001, "", "en", "src0", 0), (9001, "", "en", "src0", 0), (None, "lone words of no id", "en", None, 1)]
    own = table(spark, tiny, "documents")
    return own.unionByName(spark.createDataFrame(extra, own.schema)).withColumn("score", F.lit("x")).withColumn("_id", F.lit(1)).cache()


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


def test_toxic_rows_go(spark, tiny, docs):
    from plotline.llm import toxicity

    out = C.drop_toxic(spark, docs, tiny)
    model = toxicity.fit_toxicity(table(spark, tiny, "documents"), table(spark, tiny, "labels"))
    want = [r["doc_id"] for r in docs.collect() if model.document(r["text"], 1.0)[0] < C.TOXIC_FROM]
    assert out.columns == docs.columns and ids(out) == sorted(want, key=str)


def test_one_of_each_group_stays(spark, tiny, docs):
    out = C.drop_near_duplicates(spark, docs, tiny)
    classes = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert out.columns == docs.columns and ids(out) == sorted(classes, key=str)


def test_contaminated_rows_go(spark, tiny, docs):
    out = C.drop_contaminated(spark, docs, tiny)
    bad = {r["doc_id"] for r in decontaminate.decontaminate(docs, table(spark, tiny, "benchmark")).where("contaminated").collect()}
    assert bad and ids(out) == sorted((r["doc_id"] for r in docs.collect() if r["doc_id"] not in bad), key=str)


def test_secrets_are_redacted_and_nothing_is_lost(spark, tiny, docs):
    out = C.redact_secrets(spark, docs, tiny)
    assert out.columns == docs.columns and ids(out) == ids(docs)
    assert out.where(F.col("text").rlike("[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}")).count() == 0
    assert out.where("n_chars <> length(text) AND text LIKE '%<%>%'").count() == 0


def test_mix_and_run(spark, tiny, docs):
    out = C.mix(spark, docs, tiny)
    assert out.where("copies NOT IN (1, 2) OR size = 0").count() == 0
    result = C.run(spark, tiny)
    assert result.count() > 50 and result.groupBy("doc_id").count().where("count > 1").count() == 0
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "source_mixing"]
    assert C.mix(spark, docs.limit(0), tiny).count() == 0


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


WORDS = {k: " ".join(f"{k}{i * i}" for i in range(40)) for k in ("ant", "bee", "cow", "dog", "elk")}


def test_near_duplicates_of_null_and_repeated_ids(spark, tiny):
    w = WORDS
    rows = [(None, w["ant"], "a"), (None, w["bee"], "a"), (None, w["bee"], "b"), (None, w["cow"], "a"), (5, w["cow"], "a"), (7, w["dog"], "a"), (7, w["elk"], "a"), (7, w["elk"], "a"), (8, w["elk"].upper(), "a")]
    out = C.drop_near_duplicates(spark, rows_of(spark, rows), tiny)
    assert texts(out) == sorted([(None, w["ant"]), (None, w["bee"]), (5, w["cow"]), (7, w["dog"]), (7, w["elk"])], key=str)
    assert [r["source"] for r in out.where(out["text"] == w["bee"]).collect()] == ["a"]


def test_rejections_of_null_and_repeated_ids(spark, tiny):
    from plotline.llm import toxicity

    model = toxicity.fit_toxicity(table(spark, tiny, "documents"), table(spark, tiny, "labels"))
    bad = next(r["text"] for r in table(spark, tiny, "documents").collect() if model.document(r["text"], 1.0)[0] >= C.TOXIC_FROM)
    item = max((r["text"] for r in table(spark, tiny, "benchmark").collect()), key=len)
    for stage, text in ((C.drop_toxic, bad), (C.drop_contaminated, item)):
        rows = [(None, text, "a"), (None, WORDS["ant"], "a"), (None, None, "a"), (3, text, "a"), (3, WORDS["ant"], "a"), (4, text, "b"), (5, WORDS["bee"], "a")]
        out = stage(spark, rows_of(spark, rows), tiny)
        assert texts(out) == sorted([(None, WORDS["ant"]), (None, None), (3, WORDS["ant"]), (5, WORDS["bee"])], key=str)


def test_mix_of_null_and_repeated_ids(spark, tiny):
    from collections import Counter

    from plotline.llm import mixing

    rows = [(i // 3 if i % 4 else None, f"{'w ' * (i % 5)}t{i % 11}", "abc"[i % 3]) for i in range(60)] + [(None, "same words here", "a")] * 20 + [(None, "", "a")]
    docs = rows_of(spark, rows).withColumn("lang", F.lit("en")).cache()
    want = Counter()
    for r in mixing.mix_rows(docs).collect():
        want[r["doc_id"], r["_source"], r["_tie"], r["size"], r["taken"]] += r["taken"] > 0
    tie = F.xxhash64("text").alias("tie")
    got = Counter((r["doc_id"], r["source"], r["tie"], r["size"], r["size"] * r["copies"]) for r in C.mix(spark, docs, tiny).select("*", tie).collect())
    assert got == +want and len({k[4] // k[3] for k in got}) > 1 and sum(got.values()) < 80
