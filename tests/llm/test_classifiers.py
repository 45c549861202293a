import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.llm import langid, quality, queries, toxicity
from plotline.llm.shared import table

BIG = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, "123 !!"), (4, "a " * 100_000), (4, "a " * 100_000), (None, "The trash. You idiot."), (6, "É𝔘.\u0130")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in ODD], "doc_id long, text string, score string, held_out double")


def held(df, spark, label):
    return df.join(table(spark, BIG, "labels"), "doc_id").where("held_out").select("predicted", label).toPandas()


def test_toxicity_on_held_out_rows(spark):
    got = held(queries.op7_toxicity(spark, BIG), spark, "toxic")
    assert got[got.toxic == 1].predicted.mean() > 0.75 and got[got.toxic == 0].predicted.mean() < 0.02


def test_quality_on_held_out_rows(spark):
    got = held(queries.op8_quality(spark, BIG), spark, "quality")
    assert got[got.quality == 1].predicted.mean() > 0.97 and got[got.quality == 0].predicted.mean() < 0.15


def test_language_on_held_out_rows(spark):
    docs = table(spark, BIG, "documents").select("doc_id", "lang")
    got = queries.op10_language(spark, BIG).join(docs, "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_labels_of_held_out_rows_do_not_matter(spark, tiny):
    docs, labels = table(spark, tiny, "documents"), table(spark, tiny, "labels")
    turned = labels.withColumns({c: F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col(c)).otherwise(F.col(c)) for c in ("toxic", "quality")})
    assert toxicity.fit_toxicity(docs, labels) == toxicity.fit_toxicity(docs, turned)
    a, b = quality.fit_quality(docs, labels), quality.fit_quality(docs, turned)
    assert a.vocabulary == b.vocabulary and np.array_equal(a.weights, b.weights) and (a.bias, a.slope) == (b.bias, b.slope)


def test_offending_sentences_are_found(spark, odd):
    model = toxicity.SentenceModel({"trash": 9.0, "idiot": 9.0}, -6.0)
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(odd, model).collect()}
    assert [(s["start"], s["end"]) for s in rows[None]["spans"]] == [(0, 9), (10, 20)]
    assert rows[None]["score"] > 0.9 and rows[1]["score"] == rows[2]["score"] == 0.0


def test_edges(spark, odd, tiny):
    docs, labels = table(spark, tiny, "documents"), table(spark, tiny, "labels")
    tox, good, lang = toxicity.fit_toxicity(docs, labels), quality.fit_quality(docs, labels), langid.fit_language(docs)
    for df in (toxicity.score_toxicity(odd, tox), quality.score_quality(odd, good), langid.predict_language(odd, lang)):
        rows = df.collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    pred = {r["doc_id"]: r["lang_pred"] for r in langid.predict_language(odd, lang).collect()}
    assert pred[1] == pred[2] == pred[3] == "und" and pred[4] != "und"
    empty = docs.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels.limit(0))).count() == 0
    assert quality.score_quality(odd, quality.fit_quality(docs, labels.limit(0))).count() == len(ODD)
    assert langid.predict_language(odd, langid.fit_language(empty)).where("lang_pred <> 'und'").count() == 0


TEXTS = ["", "One two. THREE three three! é É 12", "the the the end; no end", "A line\nand another\n\n?", "word " * 3000, "Ünï çødé — ok"]


def test_toxicity_scores_by_plain_arithmetic(spark):
    model = toxicity.SentenceModel({"the": 0.7, "end": -1.2, "three": 2.0, "é": 1.0, "word": 0.1}, -1.5)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in toxicity.score_toxicity(df, model, span_score=0.5).collect():
        clean, spans, at = 1.0, [], 0
        for s in re.split(r"([.!?\n])", TEXTS[r["doc_id"]].lower()):
            if s and s not in ".!?\n":
                z = -1.5 + sum(model.weights.get(w, 0.0) for w in set(re.findall(r"[^\W\d_]+", s)))
                clean *= 1 - 1 / (1 + math.exp(-z))
                if z >= 0:
                    spans.append((at, at + len(s)))
            at += len(s)
        assert abs(r["score"] - (1 - clean)) < 1e-9 and [(s["start"], s["end"]) for s in r["spans"]] == spans


def test_noisy_or_gradient_by_differences():
    rng = np.random.default_rng(1)
    docs = np.sort(rng.integers(0, 12, 40)).astype(np.int32)
    sents = np.sort(rng.integers(0, 40, 160)).astype(np.int32)
    bags = toxicity.Bags(rng.integers(0, 15, 160).astype(np.int32), sents, docs, (rng.random(12) < 0.5).astype(float), 15)
    w, b, h = rng.normal(size=15), -1.0, 1e-6
    _, g, gb = bags.loss(w, b)
    for i in range(15):
        step = np.eye(15)[i] * h
        assert abs((bags.loss(w + step, b)[0] - bags.loss(w - step, b)[0]) / (2 * h) - g[i]) < 1e-6
    assert abs((bags.loss(w, b + h)[0] - bags.loss(w, b - h)[0]) / (2 * h) - gb) < 1e-6


def plain_grams(text):
    tokens = ["<caps>" if len(t) > 1 and t.isupper() else t.lower() for t in re.findall(r"\w+|[^\w\s]+", text)]
    words = [t for t in tokens if t.isalpha()]
    again = sum(a == b for a, b in zip(words, words[1:]))
    return set(tokens) | set(zip(tokens, tokens[1:])) | ({"<again>" if again * 10 < len(words) else "<again often>"} if again else set())


def test_quality_scores_by_plain_arithmetic(spark, tiny):
    docs, labels = table(spark, tiny, "documents"), table(spark, tiny, "labels")
    model = quality.fit_quality(docs, labels)
    names = {i: t for t, i in model.vocabulary.items()}
    size = len(names)
    weights = {(names[g] if g < size else (names[(g - size) // size], names[(g - size) % size])): w for g, w in zip(model.grams.tolist(), model.weights.tolist())}
    assert len(weights) == len(model.grams) and any(isinstance(g, tuple) for g in weights)
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(60).collect()] + list(enumerate(TEXTS, 10_000))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        found = [weights[g] for g in plain_grams(text) if g in weights]
        z = model.slope * (model.bias + sum(found) / math.sqrt(max(1, len(found)))) + model.offset
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_dual_descent_closes_the_gap():
    rng = np.random.default_rng(2)
    cols = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(60)]
    vals = [rng.normal(size=8) for _ in cols]
    y = np.sign(rng.normal(size=60))
    x = np.zeros((60, 30))
    for i, (c, v) in enumerate(zip(cols, vals)):
        x[i, c] = v
    primal = lambda w: 0.5 * w @ w + quality.COST * np.maximum(0, 1 - y * (x @ w)).sum()
    # the minimum, by subgradient steps on the primal from nothing
    best, v = np.inf, np.zeros(30)
    for t in range(1, 40_000):
        short = y * (x @ v) < 1
        best = min(best, primal(v))
        v = v - (v - quality.COST * (y[short][:, None] * x[short]).sum(axis=0)) / t
    assert primal(quality.dual_descent(cols, vals, y, 30, epochs=300)) <= best * 1.001
    assert primal(quality.dual_descent(cols, vals, y, 30)) <= best * 1.03


def test_language_features_and_scores_by_plain_arithmetic(spark):
    for text in TEXTS + ["\U0001d518 x", "a_b²c", "ß" * 10]:
        plain = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
        if plain.strip():
            assert "".join(map(chr, langid.plain_points(text).astype(int))) == plain
    rng = np.random.default_rng(3)
    size = 1 << langid.BITS
    model = langid.LanguageModel(("aa", "bb", "cc"), rng.normal(size=(size, 3)).astype(np.float32), np.array([0.1, 0.0, -0.2]), 0.5)
    rows = [(i, t) for i, t in enumerate(TEXTS) if t]
    got = {r["doc_id"]: r for r in langid.predict_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        ids = langid.gram_ids(text).tolist()
        z = [(model.bias[c] + sum(float(model.table[j, c]) for j in ids) / len(ids)) / 0.5 for c in range(3)]
        p = [math.exp(v - max(z)) for v in z]
        assert got[i]["lang_pred"] == model.langs[p.index(max(p))] and abs(got[i]["score"] - max(p) / sum(p)) < 1e-6
    tied = langid.LanguageModel(("aa", "bb"), np.zeros((size, 2), np.float32), np.zeros(2), 1.0)
    assert tied.predict("any") == ("aa", 0.5)


def test_leader_is_the_best_of_its_gradients():
    """The weights minimise the sum of gradients times weights, the proximal terms and both penalties."""
    leader = langid.Leader(3, 2)
    rng = np.random.default_rng(4)
    ids = np.arange(3)
    for _ in range(6):
        leader.learn(ids, rng.normal(size=3), int(rng.integers(2)))
    w, z, n2 = leader.weights(ids), leader.z, leader.n2

    def cost(v):
        return z * v + 0.5 * v * v * ((langid.BETA + np.sqrt(n2)) / langid.ALPHA + langid.L2) + langid.L1 * np.abs(v)

    for step in (1e-4, -1e-4, 0.1, -0.1):
        assert (cost(w) <= cost(w + step) + 1e-15).all()


def test_samples(spark):
    from plotline.llm.shared import balanced_sample, labelled_sample

    long = "long " * 30_000
    docs = [(i, f"text {i}", "en") for i in range(200)] + [(None, "no id", "en"), (201, long, "de"), (5, "text 5", "en"), (7, "other 7", "de"), (9, None, "fr"), (300, "x", None), (301, "y", "fr"), (301, "y", "de")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = [(i, i % 2) for i in range(150)] + [(3, 0), (201, 1), (999, 1), (None, 1), (4, None)]
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = labelled_sample(d, y, "toxic", 1000)
    fold = lambda i: __import__("zlib").crc32(str(i).encode()) % 4
    want = [(i, t, i % 2) for i, t in {(i, t) for i, t, _ in docs if i is not None and t and i < 150} if fold(i) != 2 and i != 3]
    assert got == sorted(want + ([(201, long, 1)] if fold(201) != 2 else []))
    few = labelled_sample(d, y, "toxic", 20)
    assert len(few) == 20 and few == labelled_sample(d.repartition(7), y.repartition(5), "toxic", 20) and set(few) <= set(got)
    langs = [r[2] for r in balanced_sample(d, "lang", 40)]
    assert len(langs) == 40 and langs.count("de") == sum(fold(i) != 2 for i in (201, 7)) and "fr" not in langs
