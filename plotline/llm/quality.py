"""Quality classifier: support vectors on naive Bayes features.

Indicators of token n-grams are scaled by the log-count ratio of the two classes; a
linear hinge-loss model on them is fitted by dual coordinate descent, and its margins
are turned into probabilities by a logistic fit on training rows it has not seen.
"""

from __future__ import annotations

import math
import operator
import re
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
SAMPLE_ROWS = 4000
#: N-grams in fewer training documents are no features.
MIN_DOCS = 3
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 15
#: Every CALIBRATION-th training row sets the probabilities instead of the margin.
CALIBRATION = 4

_TOKEN = re.compile(r"\w+|[^\w\s]+")
AGAIN, OFTEN = "<again>", "<again often>"


def shape(token: str) -> str:
    """Tokens in lower case; those all in capitals are one."""
    return "<caps>" if len(token) > 1 and token.isupper() else token.lower()


class Memo(dict):
    """What ``make`` gives for a token, remembered for up to MOST tokens."""

    MOST = 1 << 18

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: str):
        if len(self) >= self.MOST:
            self.clear()
        self[token] = value = self.make(token)
        return value


def _word(token: str) -> str | None:
    token = shape(token)
    return token if token.isalpha() else None


class Grams:
    """Features of texts: of the tokens in ``vocabulary`` those that occur, and pairs of
    them that follow one another, as numbers first * size + second beyond the tokens."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.size = vocabulary, len(vocabulary)
        self.ids = Memo(lambda t: vocabulary.get(shape(t), -1))
        self.words = Memo(_word)

    def of(self, text: str) -> np.ndarray:
        tokens = _TOKEN.findall(text)
        ids = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        known = ids >= 0
        pairs = (ids[:-1] * self.size + ids[1:])[known[:-1] & known[1:]] + self.size
        words = list(filter(None, map(self.words.__getitem__, tokens)))
        again = sum(map(operator.eq, words, words[1:]))
        mark = self.vocabulary.get(AGAIN if again * 10 < len(words) else OFTEN, -1) if again else -1
        return np.unique(np.concatenate([ids[known], pairs, [mark] if mark >= 0 else []]).astype(np.int64))


@dataclass(frozen=True)
class MarginModel:
    vocabulary: dict[str, int]
    grams: np.ndarray  # the features' numbers, ascending
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, grams: np.ndarray) -> float:
        at = np.minimum(np.searchsorted(self.grams, grams), max(0, len(self.grams) - 1))
        found = self.weights[at[self.grams[at] == grams]] if len(self.grams) else self.weights
        margin = self.bias + found.sum() / math.sqrt(max(1, len(found)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * margin + self.offset))))


def dual_descent(cols: list[np.ndarray], vals: list[np.ndarray], y: np.ndarray, size: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of min |w|^2/2 + COST * sum of hinge losses, one dual variable at a time."""
    w, alpha = np.zeros(size), np.zeros(len(y))
    norms = np.array([v @ v for v in vals]) + 1e-12
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            gain = (1 - y[i] * (w[cols[i]] @ vals[i])) / norms[i]
            new = min(max(alpha[i] + gain, 0.0), COST)
            if new != alpha[i]:
                w[cols[i]] += (new - alpha[i]) * y[i] * vals[i]
                alpha[i] = new
    return w


def train(rows: list[tuple]) -> MarginModel:
    """Fit on (doc_id, text, label) rows; without both classes every score is that class's."""
    y = np.array([1.0 if label == 1 else -1.0 for *_, label in rows])
    if not len(y) or y.min() == y.max():
        return MarginModel({}, np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0, 0.0 if not len(y) else 6.0 * y[0])
    seen: Counter = Counter({AGAIN: MIN_DOCS, OFTEN: MIN_DOCS})
    for _, text, _ in rows:
        seen.update(set(map(shape, set(_TOKEN.findall(text)))))
    # a pair is in no more documents than either of its tokens
    vocabulary = {t: i for i, t in enumerate(sorted(t for t, n in seen.items() if n >= MIN_DOCS))}
    del seen
    grams = Grams(vocabulary)
    bags = [grams.of(text) for _, text, _ in rows]
    kept, counts = np.unique(np.concatenate(bags), return_counts=True)
    kept = kept[counts >= MIN_DOCS]
    cols = [np.searchsorted(kept, bag[np.isin(bag, kept, assume_unique=True)]).astype(np.int32) for bag in bags]
    del bags, counts
    counts = {s: np.full(len(kept), SMOOTHING) for s in (-1.0, 1.0)}
    for c, s in zip(cols, y):
        counts[s][c] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    # each document is scaled by the root of its number of features; the last column is the bias
    cols = [np.append(c, len(kept)) for c in cols]
    vals = [np.append(ratio[c[:-1]] / math.sqrt(max(1, len(c) - 1)), 1.0) for c in cols]
    order = np.arange(len(y))
    fit = order[order % CALIBRATION != 0] if len(y) >= 40 else order
    held = order[order % CALIBRATION == 0] if len(y) >= 40 else order
    w = dual_descent([cols[i] for i in fit], [vals[i] for i in fit], y[fit], len(kept) + 1)
    margins = np.array([w[cols[i]] @ vals[i] for i in held])
    slope, offset = logistic_line(margins, (y[held] > 0).astype(float))
    return MarginModel(vocabulary, kept, w[:-1] * ratio, float(w[-1]), slope, offset)


def logistic_line(x: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with smoothed targets, by Newton's method."""
    n1 = t.sum()
    t = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (len(t) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> MarginModel:
    """Train on a sample of at most ``rows`` labelled documents outside the held-out fold."""
    return train(labelled_sample(docs, labels, "quality", rows))


def score_quality(docs: DataFrame, model: MarginModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and the probability of label 1.

    Null and empty texts have no n-gram and get the bias's probability. Repeated rows
    and null ids are scored and returned each; other columns are not read; an empty
    table gives an empty result. Row by row: no shuffle.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each n-gram of the bounded sample, at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        grams = Grams(own.vocabulary)
        for batch in batches:
            scores = [own.score(grams.of(text.as_py() or "")) for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["_id", "score"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {id_type}, score double").withColumnRenamed("_id", id_col)
