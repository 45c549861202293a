"""Embedding whitening: compensated covariance and principal components.

Entries become whole numbers x = floor(64 c) + 1000000, far from zero compared with their
spread, so that plain sums of squares would lose most digits. The mean is exact, S / n with
integer S. Outer products of the centred rows are taken as double-double numbers: an
error-free product or sum keeps what rounding cuts off in a second, low part. Each task
adds up its rows into one high and one low matrix, and these are merged in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.shared import written
from plotline.session import ship

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Beyond this a scaled entry is no whole number that a double holds exactly.
LARGEST = 2.0**51
#: Eigenvalues below this share of their sum are rounding errors of a covariance without full rank.
RANK_SHARE = 1e-12
#: Products that a task holds at once; a single row of D entries has D * (D + 1) / 2.
AT_ONCE = 1 << 18

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b rounded, and what the rounding cut off (Knuth)."""
    s = a + b
    v = s - a
    return s, (a - (s - v)) + (b - v)


def fast_two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """As ``two_sum``, for a that is not smaller than b."""
    s = a + b
    return s, b - (s - a)


def split(a: np.ndarray) -> Pair:
    """``a`` as a sum of two halves of 26 bits (Veltkamp)."""
    c = a * 134217729.0
    high = c - (c - a)
    return high, a - high


def add(a: Pair, b: Pair) -> Pair:
    """Sum of two double-double arrays."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = fast_two_sum(s, e + t)
    return fast_two_sum(s, e + f)


def outer(rows: Pair) -> Pair:
    """For each row, the products of its entries i <= j, row by row of the upper triangle.

    Dekker's product of the high parts is exact; of the low ones only what a
    double-double holds is kept.
    """
    high, low = rows
    i, j = np.triu_indices(high.shape[1])
    h, t = split(high)
    a, b = high[:, i], high[:, j]
    ah, at, bh, bt = h[:, i], t[:, i], h[:, j], t[:, j]
    p = a * b
    e = ((ah * bh - p) + ah * bt + at * bh) + at * bt
    return fast_two_sum(p, e + (a * low[:, j] + low[:, i] * b))


def total(rows: Pair) -> Pair:
    """Sum of all rows, by halves."""
    high, low = rows
    while len(high) > 1:
        half = len(high) // 2
        s = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = (np.concatenate([x, y[2 * half :]]) for x, y in zip(s, (high, low)))
    return high[0], low[0]


@dataclass(frozen=True)
class Whitening:
    """Mean and components of a fit list of ``n`` vectors; ``floor`` and ``rest`` are the
    parts of the sums S = floor * n + rest."""

    n: int
    floor: np.ndarray
    rest: np.ndarray
    components: np.ndarray  # one a column
    eigenvalues: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> Pair:
        return centred(x, self.n, self.floor, self.rest)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centred(x)
        return (high @ self.components + low @ self.components) / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly; null beyond a long."""
        apart = x - self.floor
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if most * most * x.shape[1] < 2**63:
            d = self.n * apart - self.rest
            return (d * d).sum(axis=1).tolist()
        d = apart.astype(object) * self.n - self.rest.astype(object)
        return [v if v < 2**63 else None for v in (d * d).sum(axis=1).tolist()]


def centred(x: np.ndarray, n: int, floor: np.ndarray, rest: np.ndarray) -> Pair:
    """x - S / n as a double-double: whole numbers apart from the floor of the mean, less
    the rest's n-th part."""
    share = rest / n
    # rest / n in two parts; rest - share * n is exact as integers
    over = np.array([float((int(r) * int(d) - int(m) * n) / (int(d) * n)) for r, (m, d) in zip(rest, (float(s).as_integer_ratio() for s in share))])
    high, low = two_sum((x - floor).astype(np.float64), np.broadcast_to(-share, x.shape))
    return fast_two_sum(high, low - over)


def _matrix(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(-1, width)


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (_id, _x) of the vectors that take part, entries as whole numbers."""
    v = F.col(vec_col)
    fits = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < LARGEST, F.lit(False)))  # NaN counts as largest
    x = F.when(fits, F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET))
    rows = vectors.select(F.col(id_col).alias("_id"), x.alias("_x")).where(F.col("_x").isNotNull() & (F.size("_x") > 0))
    width = rows.groupBy(F.size("_x").alias("_d")).count().orderBy(F.desc("count"), F.desc("_d")).take(1)
    return rows.where(F.size("_x") == (width[0]["_d"] if width else 0))


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of their entries; a task passes on one row a dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * width, [0] * width
        for batch in batches:
            x = _matrix(batch, 0, width)
            n += len(x)
            high = [a + b for a, b in zip(high, (x >> 26).sum(axis=0).tolist())]
            low = [a + b for a, b in zip(low, (x & ((1 << 26) - 1)).sum(axis=0).tolist())]
        sums = [str((a << 26) + b) for a, b in zip(high, low)]
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(sums)], ["_i", "_n", "_s"])

    parts = fit.select("_x").mapInArrow(run, "_i int, _n bigint, _s string")
    found = parts.groupBy("_i").agg(F.sum("_n").alias("n"), F.sum(F.col("_s").cast("decimal(38,0)")).alias("s")).collect()  # a row for each dimension
    at = {r["_i"]: r for r in found}
    return (at[0]["n"], [int(at[i]["s"]) for i in range(width)]) if at else (0, [])


def compensated(fit: DataFrame, width: int, prepare: Callable[[np.ndarray], Pair], size: int, products: bool) -> Pair:
    """Sum over the fit list of the outer products of ``prepare``'s rows, of ``size``
    entries each, or of these rows themselves; high and low parts.

    Tasks add up their rows and pass on a row for each row of the upper triangle. Partial
    sums of one such row meet in one task, which adds them as they come and holds no more
    than the triangle.
    """
    lengths = list(range(size, 0, -1)) if products else [size]
    ends = np.cumsum(lengths)
    many = int(ends[-1])

    def pieces(x: np.ndarray) -> Iterator[Pair]:
        step = max(1, AT_ONCE // many)
        for at in range(0, len(x), step):
            high, low = prepare(x[at : at + step])
            yield total(outer((high, low)) if products else (high, low))

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(many), np.zeros(many)
        for batch in batches:
            for part in pieces(_matrix(batch, 0, width)):
                sums = add(sums, part)
        yield _rows({i: tuple(s[e - k : e] for s in sums) for i, (e, k) in enumerate(zip(ends, lengths))})

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Pair] = {}
        for batch in batches:
            for i, high, low in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                part = np.asarray(high.values), np.asarray(low.values)
                sums[i] = add(sums[i], part) if i in sums else part
        yield _rows(sums)

    schema = "_i int, _high array<double>, _low array<double>"
    merged = fit.select("_x").mapInArrow(gather, schema).repartition("_i").mapInArrow(merge, schema)
    found = sorted(merged.collect())  # a row for each row of the triangle
    return tuple(np.concatenate([np.array(r[k], np.float64) for r in found]) if found else np.zeros(many) for k in (1, 2))


def _rows(sums: dict[int, Pair]) -> pa.RecordBatch:
    lists = [pa.array([s[k] for s in sums.values()], pa.list_(pa.float64())) for k in (0, 1)]
    return pa.record_batch([pa.array(list(sums), pa.int32()), *lists], ["_i", "_high", "_low"])


def _square(triangle: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = triangle
    return out + np.triu(out, 1).T


def principal(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors, one a column.

    ``eigh`` is LAPACK's syevd: Householder reflections to a tridiagonal matrix, which is
    solved by divide and conquer. Signs are set so that the entry of largest magnitude is
    positive. Eigenvalues that a covariance without full rank has by rounding are left out.
    """
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > RANK_SHARE * np.trace(covariance)]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values[order], vectors * signs


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Mean and components of the rows ``_x`` of ``fit``; None where there are none."""
    n, sums = _sums(fit, width)
    if not n:
        return None
    floor, rest = (np.array(v, np.int64) for v in zip(*(divmod(s, n) for s in sums)))
    high, low = compensated(fit, width, lambda x: centred(x, n, floor, rest), width, products=True)
    covariance = _square(high / n + low / n, width)
    values, vectors = principal(covariance, components)
    trace = np.trace(covariance)
    return Whitening(n, floor, rest, vectors, values, values / trace if trace else values)


def identity_error(fit: DataFrame, width: int, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance less the identity, over the fit list,
    centred before multiplying."""
    k = len(model.eigenvalues)

    def plain(x: np.ndarray) -> Pair:
        w = model.whitened(x)
        return w, np.zeros_like(w)

    high, low = compensated(fit, width, plain, k, products=False)
    mean, over = high / model.n, low / model.n

    def apart(x: np.ndarray) -> Pair:
        w, e = two_sum(model.whitened(x), np.broadcast_to(-mean, (len(x), k)))
        return fast_two_sum(w, e - over)

    high, low = compensated(fit, width, apart, k, products=True)
    return float(np.abs(_square(high / model.n + low / model.n, k) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row that takes part and component: id, component (from 1), n, deviation,
    whitened, explained, identity_error.

    Rows take no part whose vector is null or empty, holds a null, NaN or infinite entry
    or one whose 64-fold is beyond 2^51 (no double holds its floor's neighbours), or whose
    length is not the table's most common one (of equally common ones the longer).
    Repeated vectors count once in the fit and are returned each, as are null and repeated
    ids. There are as many components as the covariance has rank, ``components`` at most:
    none for a table without two different vectors, which gives an empty result, as an
    empty table does. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = "_id " + id_type + ", component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = whole_vectors(vectors, id_col, vec_col)
    fit = written(rows.select("_x").distinct(), "fit-list")
    first = fit.take(1)
    width = len(first[0]["_x"]) if first else 0
    model = fit_whitening(fit, width, components) if first else None
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    error = identity_error(fit, width, model)
    sent = spark.sparkContext.broadcast((model, error))  # components times dimensions

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, off = sent.value
        k = len(own.eigenvalues)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                x = _matrix(batch, 1, width)
                m = len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, own.n, np.int64)),
                        pa.array(own.deviation(x), pa.int64()).take(pa.array(each)),
                        pa.array(own.whitened(x).ravel()),
                        pa.array(np.tile(own.explained, m)),
                        pa.array(np.full(m * k, off)),
                    ],
                    ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
