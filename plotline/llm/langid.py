"""Language identification.

Sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams,
trained one document at a time by follow-the-regularised-leader with elastic-net
penalties; the probabilities are then calibrated by one temperature.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.shared import balanced_sample
from plotline.session import ship

#: At most so many documents are trained on, each with its whole text.
SAMPLE_ROWS = 2500
BITS = 16
ORDERS = (1, 2, 3)
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-3, 1e-3
EPOCHS = 4
#: Every CALIBRATION-th training document sets the temperature instead of the weights.
CALIBRATION = 5

UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter: alphanumeric and no decimal digit."""
    return np.fromiter((chr(c).isalnum() and not chr(c).isdecimal() for c in range(0x110000)), bool, 0x110000)


def plain_points(text: str) -> np.ndarray:
    """Code points of a text in lower case, its words set off by single spaces."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = np.concatenate([[False], _letters()[points], [False]])
    # of each run of other characters one stays, as a space; there is one at either end
    kept = letter | np.concatenate([[True], letter[:-1]])
    return np.where(letter, np.concatenate([[32], points, [32]]), 32)[kept].astype(np.uint64)


def gram_ids(text: str) -> np.ndarray:
    """Hashed n-grams of the letters of a text."""
    points = plain_points(text)
    out, h = [], np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            out.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    table: np.ndarray  # inverse document frequency times weight, by n-gram and language
    bias: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        ids = gram_ids(text)
        z = (self.bias + self.table[ids].sum(axis=0, dtype=np.float64) / max(1, len(ids))) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


class Leader:
    """Follow-the-regularised-leader for a softmax over ``k`` classes: the weights are those
    that are best for all gradients so far, with step sizes of their own and both penalties."""

    def __init__(self, size: int, k: int):
        self.z, self.n2 = np.zeros((size, k)), np.zeros((size, k))

    def weights(self, ids: np.ndarray) -> np.ndarray:
        z, n2 = self.z[ids], self.n2[ids]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n2)) / ALPHA + L2))

    def learn(self, ids: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(ids)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n2 = self.n2[ids]
        self.z[ids] += g - (np.sqrt(n2 + g * g) - np.sqrt(n2)) / ALPHA * w
        self.n2[ids] = n2 + g * g


def train(rows: list[tuple]) -> LanguageModel:
    """Fit on (doc_id, text, lang) rows; with no row there is no language to predict."""
    langs = tuple(sorted({r[2] for r in rows}))
    size, k = 1 << BITS, max(1, len(langs))
    if len(langs) < 2:
        return LanguageModel(langs, np.zeros((size, k), np.float32), np.zeros(k), 1.0)
    bags = [(ids.astype(np.int32), n.astype(np.float32)) for ids, n in (np.unique(gram_ids(text), return_counts=True) for _, text, _ in rows)]
    y = np.array([langs.index(r[2]) for r in rows])
    seen = np.zeros(size)
    for ids, _ in bags:
        seen[ids] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    # the bias is a feature of its own, index size
    feats = [(np.append(ids, np.int32(size)), np.append(n / n.sum() * idf[ids], 1.0).astype(np.float32)) for ids, n in bags]
    del bags
    order = np.random.default_rng(11).permutation(len(rows))
    fit = order[len(order) // CALIBRATION :] if len(order) >= 50 else order
    held = order[: len(order) // CALIBRATION] if len(order) >= 50 else order
    leader = Leader(size + 1, k)
    for _ in range(EPOCHS):
        for i in fit:
            leader.learn(*feats[i], y[i])
    w = leader.weights(np.arange(size + 1))
    logits = np.array([x @ w[ids] for ids, x in (feats[i] for i in held)])

    def loss(t: float) -> float:
        s = logits / t
        s -= s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), y[held]]).mean())

    temperature = min(np.geomspace(0.02, 20, 200), key=loss)
    return LanguageModel(langs, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], float(temperature))


def fit_language(docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Train on a sample of at most ``rows`` documents with a language, outside the
    held-out fold, as many of each language as there are up to an equal share."""
    return train(balanced_sample(docs, "lang", rows))


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, lang_pred and score, the calibrated probability.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learnt; of equally likely languages the first by name. Repeated rows and null ids are predicted and returned each; other columns
    are not read; an empty table gives an empty result. Row by row: no shuffle.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            out = [own.predict(t.as_py()) if ok.as_py() and own.langs else (UNDETERMINED, 0.0) for t, ok in zip(batch.column(1), batch.column(2))]
            yield pa.record_batch([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    return rows.mapInArrow(run, f"_id {id_type}, lang_pred string, score double").withColumnRenamed("_id", id_col)
