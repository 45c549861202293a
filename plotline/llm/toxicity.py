"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score on its words; the
document's score is their noisy-or, 1 - prod(1 - p). Only document labels are known:
the gradient of the noisy-or likelihood reaches the sentences, so that the model also
says which sentences offend.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.shared import labelled_sample
from plotline.session import ship

#: At most so many labelled documents are trained on, each with its whole text.
SAMPLE_ROWS = 6000
#: Words in fewer training documents are no features.
MIN_DOCS = 4
STEPS = 150
RATE = 0.3
L1 = 2e-4

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class SentenceModel:
    weights: dict[str, float]
    bias: float

    def sentence(self, text: str) -> float:
        weights = self.weights
        z = self.bias + sum(weights[w] for w in set(_WORD.findall(text)) if w in weights)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def document(self, text: str | None, above: float) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of the sentences, and (start, end, score) of those of ``above`` or more."""
        lower = (text or "").lower()
        if len(lower) != len(text or ""):  # a few letters change length; offsets must hold
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
        rest, spans = 0.0, []
        for m in _SENTENCE.finditer(lower):
            p = self.sentence(m[0])
            rest += math.log1p(-min(p, 1 - 1e-12))
            if p >= above:
                spans.append((m.start(), m.end(), p))
        return -math.expm1(rest), spans


@dataclass(frozen=True)
class Bags:
    """Documents as bags of sentences, in flat arrays: the words of all sentences, the
    sentence of each word, the document of each sentence, the label of each document."""

    cols: np.ndarray
    sent_of: np.ndarray
    doc_of: np.ndarray
    y: np.ndarray
    n_words: int

    def loss(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """Mean negative log-likelihood of the labels under the noisy-or, and its gradient."""
        z = b + np.bincount(self.sent_of, weights=w[self.cols], minlength=len(self.doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(self.doc_of, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(self.y))
        q = np.exp(clean)
        value = -np.where(self.y > 0, np.log(np.maximum(1 - q, 1e-9)), clean).mean()
        pull = np.where(self.y > 0, -q / np.maximum(1 - q, 1e-9), 1.0)[self.doc_of] * p / len(self.y)
        return float(value), np.bincount(self.cols, weights=pull[self.sent_of], minlength=self.n_words), float(pull.sum())


def train(rows: list[tuple]) -> SentenceModel:
    """Fit on (doc_id, text, label) rows; without both classes the score is the base rate's."""
    y = np.array([float(label == 1) for *_, label in rows])
    if not len(y) or y.min() == y.max():
        return SentenceModel({}, -20.0 if not len(y) or y.max() == 0 else 20.0)
    seen: Counter = Counter()
    for _, text, _ in rows:
        seen.update(set(_WORD.findall(text.lower())))
    words = sorted(w for w, n in seen.items() if n >= MIN_DOCS)
    index = {w: i for i, w in enumerate(words)}
    del seen
    # flat arrays from the start: sets of words for each sentence would not fit a small driver
    cols, sizes, doc_of = array("i"), array("i"), array("i")
    for d, (_, text, _) in enumerate(rows):
        for sentence in _SENTENCE.findall(text.lower()) or [""]:
            known = sorted({index[w] for w in _WORD.findall(sentence) if w in index})
            cols.extend(known)
            sizes.append(len(known))
            doc_of.append(d)
    bags = Bags(np.array(cols, np.int32), np.repeat(np.arange(len(doc_of), dtype=np.int32), np.array(sizes, np.int32)), np.array(doc_of, np.int32), y, len(words))
    w, b = np.zeros(len(words)), -6.0
    # rare words of offending documents only start the search; the likelihood decides
    positive = np.bincount(bags.cols, weights=y[bags.doc_of[bags.sent_of]], minlength=len(words))
    total = np.maximum(np.bincount(bags.cols, minlength=len(words)), 1)
    w += np.clip(np.log((positive + 0.5) / (total - positive + 0.5)) - math.log(y.mean() / (1 - y.mean())), -1, 3)
    m1, m2, mb1, mb2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        _, g, gb = bags.loss(w, b)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.99 * mb2 + 0.01 * gb * gb
        rate = RATE / (1 + t / 50)
        scale = np.sqrt(m2 / (1 - 0.99**t)) + 1e-5
        w = w - rate * m1 / (1 - 0.9**t) / scale
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1 / scale, 0)
        b -= rate * mb1 / (1 - 0.9**t) / (math.sqrt(mb2 / (1 - 0.99**t)) + 1e-5)
    return SentenceModel({words[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)}, float(b))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> SentenceModel:
    """Train on a sample of at most ``rows`` labelled documents outside the held-out fold."""
    return train(labelled_sample(docs, labels, "toxic", rows))


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def score_toxicity(docs: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text", span_score: float = 0.3) -> DataFrame:
    """Per document: id, score and the offending sentences (start, end, score).

    Offsets count characters, end exclusive. Null and empty texts have no sentence and
    score 0. Repeated rows and null ids are scored and returned each; other columns are
    not read; an empty table gives an empty result. Row by row: no shuffle.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each word of the bounded sample, at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1):
                p, found = own.document(text.as_py(), span_score)
                scores.append(p)
                spans.append([dict(zip(("start", "end", "score"), s)) for s in found])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(SPAN))], ["_id", "score", "spans"])

    ddl = f"_id {id_type}, score double, spans array<struct<start:bigint,end:bigint,score:double>>"
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, ddl).withColumnRenamed("_id", id_col)
