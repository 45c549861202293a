"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform; a unit
vector hashes to the signed axis nearest to its rotation. A table concatenates several
such hashes, more of them the more vectors there are. A query's loss at a bucket is how
much nearer its rotations are to their own axes than to the bucket's, added up over the
hashes; it probes all buckets up to one loss, which is fitted on a bounded sample of
queries whose true neighbours are known. What the probes find is reranked by the exact
inner product of the original vectors.

Vectors are dealt to slices and queries to portions, by their hash, so that no bucket can
be hot; a task keeps the tables of a slice and has a portion of the queries probe them. A
bucket is compared with all queries that probe it by one product of matrices, as
telling which of its vectors each query may skip would take longer than that.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from plotline.llm.shared import join_spread, written
from plotline.session import ship

TABLES = 4
#: The loss is fitted so that this share of the sampled queries' neighbours is found.
RECALL = 0.955
SAMPLE_QUERIES = 96
#: Vectors that a task's bucket has on average at least, if they lie evenly; sets the number of hashes.
BUCKET_ROWS = 8
#: Buckets of a table at most, unless it has one hash.
MOST_CODES = 1 << 16
#: Components of the vectors, and of the queries, of one task at most, about.
TASK_VALUES = 1 << 23
QUERY_VALUES = 1 << 20
#: Tasks at least, unless slices would be smaller than so many vectors. Not by the number of
#: cores, so that what is found does not hang on it.
LEAST_TASKS = 48
SLICE_ROWS = 2048
#: Candidates held at once in a task, and scores computed at once.
HELD = 1_000_000
SCORES = 1 << 18
#: A task's vectors of the smallest ids, with which all its queries are compared for a first bound.
FIRST = 512
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Hadamard transform of the rows, whose length is a power of two."""
    rows, n = x.shape
    h = 1
    while h < n:
        x = x.reshape(rows, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


class Hashes:
    """``depth`` hashes in each of ``tables`` tables for vectors of ``dim`` components."""

    def __init__(self, dim: int, tables: int, depth: int, seed: int = SEED):
        self.dim, self.tables, self.depth = dim, tables, depth
        self.n = 1 << max(0, dim - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, depth, 3, self.n))

    def nearness(self, vectors: np.ndarray, table: int) -> list[np.ndarray]:
        """For each hash of the table, the rows' coordinates on all signed axes."""
        unit = np.zeros((len(vectors), self.n))
        # scaled first, so that neither very large nor very small components leave the range
        unit[:, : self.dim] = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        out = []
        for signs in self.signs[table]:
            y = unit
            for s in signs:
                y = hadamard(y * s)
            out.append(np.concatenate([-y, y], axis=1))
        return out

    def losses(self, vectors: np.ndarray, table: int) -> list[np.ndarray]:
        return [y.max(axis=1, keepdims=True) - y for y in self.nearness(vectors, table)]

    def buckets(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """The rows' axes, one column for each hash."""
        # in pieces, whose rotations stay small
        pieces = [vectors[at : at + 4096] for at in range(0, len(vectors), 4096)]
        return np.concatenate([np.column_stack([y.argmax(axis=1) for y in self.nearness(p, table)]) for p in pieces]).astype(np.int32)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), dim)


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_every: int = 20,
    k: int = 20,
    tables: int = TABLES,
    recall: float = RECALL,
    task_rows: int | None = None,
    task_queries: int | None = None,
) -> DataFrame:
    """Rows query_id, rank, vec_id, score: for each query (id divisible by ``query_every``)
    the ``k`` nearest vectors found, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor
    do those without an id. Vectors of different lengths have no inner product: each
    length is searched by itself. Repeated ids count once, with the smallest vector. A
    query finds as many as there are, up to ``k``. An empty table gives an empty result;
    other columns are not read.

    Equal vectors are one entry of the index, with their ``k`` + 1 smallest ids (no more
    can be among a query's nearest), and one query, however many ids they have. Tasks
    hold about ``task_rows`` entries and ``task_queries`` queries at most, or else as many
    as have TASK_VALUES and QUERY_VALUES components.
    """
    ship(vectors.sparkSession)
    # single precision is kept until scores are computed: half the bytes to shuffle
    kind = "array<float>" if vectors.schema[vector_col].dataType == ArrayType(FloatType()) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast(kind).alias("_v"))
    rows = rows.where(F.col("_id").isNotNull() & usable(F.col("_v"))).groupBy("_id").agg(F.min("_v").alias("_v"))
    rows = written(rows.withColumn("_dim", F.size("_v")), "vectors")
    out = rows.select(F.col("_id").alias("query_id"), F.lit(1).alias("rank"), F.col("_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    # one row for each length that occurs
    for length in rows.groupBy("_dim").agg(F.count(F.lit(1)).alias("n")).orderBy("_dim").collect():
        if length["n"] > 1:
            same = rows.where(F.col("_dim") == length["_dim"]).drop("_dim")
            out = out.unionByName(_nearest(same, length["_dim"], query_every, k, tables, recall, task_rows, task_queries))
    return out


def depth_for(entries: float, dim: int) -> int:
    """Hashes of a table for a slice of so many entries: as many as leave BUCKET_ROWS in a bucket."""
    axes = 2 << max(0, dim - 1).bit_length()
    return max(1, math.floor(math.log(max(1.0, min(entries / BUCKET_ROWS, MOST_CODES))) / math.log(axes) + 1e-9))


def blocks_for(entries: int, queries: int, task_rows: int, task_queries: int) -> tuple[int, int]:
    """Slices of the entries and portions of the queries: by the sizes of a task, and more
    slices where that would make few tasks."""
    portions = max(1, math.ceil(queries / task_queries))
    spread = min(math.ceil(LEAST_TASKS / portions), math.ceil(entries / SLICE_ROWS))
    return max(1, math.ceil(entries / task_rows), spread), portions


def _nearest(rows: DataFrame, dim: int, every: int, k: int, tables: int, recall: float, task_rows: int | None, task_queries: int | None) -> DataFrame:
    same = Window.partitionBy("_v").orderBy("_id")
    first = rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1)
    entries = written(first.groupBy("_v").agg(F.array_sort(F.collect_list("_id")).alias("_ids")), "entries")
    queries = rows.where(F.col("_id") % every == 0)
    asked = written(queries.groupBy("_v").agg(F.min("_id").alias("_q")), "asked")
    n = entries.count()
    task_rows, task_queries = task_rows or max(1, TASK_VALUES // dim), task_queries or max(1, QUERY_VALUES // dim)
    slices, portions = blocks_for(n, asked.count(), task_rows, task_queries)
    hashes = Hashes(dim, tables, depth_for(n / slices, dim))
    found = _probe(entries, asked, hashes, fitted_loss(entries, asked, hashes, k, recall), k + 1, slices, portions)
    # a row for each slice; each query's rows are few
    best = F.array_sort(F.flatten(F.collect_list("_best")))
    hits = found.groupBy("_q").agg(F.slice(best, 1, k + 1).alias("_hits"))
    hits = written(asked.join(hits, "_q").select("_v", "_hits"), "hits")
    answered = join_spread(queries, hits, "_v", how="inner")
    others = F.slice(F.filter("_hits", lambda h: h["_id"] != F.col("_id")), 1, k)
    ranked = answered.select(F.col("_id").alias("query_id"), F.posexplode(others).alias("_p", "_h"))
    return ranked.select("query_id", (F.col("_p") + 1).alias("rank"), F.col("_h._id").alias("vec_id"), (-F.col("_h._less")).alias("score"))


def fitted_loss(entries: DataFrame, asked: DataFrame, hashes: Hashes, k: int, recall: float) -> float:
    """The loss up to which buckets must be probed to find ``recall`` of the neighbours of
    at most SAMPLE_QUERIES queries, told by comparing these with all entries, in blocks."""
    sample = asked.orderBy(F.xxhash64("_q"), "_q").limit(SAMPLE_QUERIES).collect()
    if not sample:
        return 0.0
    q = np.array([r["_v"] for r in sample])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(0), hashes.dim)
            scores = q @ v.T
            n = min(k + 1, len(v))
            top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            i = np.repeat(np.arange(len(q)), n)
            yield pa.record_batch([pa.array(i), pa.array(scores[i, top.ravel()]), batch.column(0).take(pa.array(top.ravel()))], ["_i", "_score", "_v"])

    near = entries.select("_v").mapInArrow(run, f"_i bigint, _score double, _v {entries.schema['_v'].dataType.simpleString()}")
    best = Window.partitionBy("_i").orderBy(F.desc("_score"), "_v")
    near = near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).select("_i", "_v").collect()  # the sample's neighbours
    i, v = np.array([r["_i"] for r in near]), np.array([r["_v"] for r in near])
    least = np.full(len(i), np.inf)
    for t in range(hashes.tables):
        axes, losses = hashes.buckets(v, t), hashes.losses(q, t)
        least = np.minimum(least, sum(loss[i, axes[:, j]] for j, loss in enumerate(losses)))
    apart = least[(v != q[i]).any(axis=1)]  # a query's own entry is found at no loss
    return float(np.quantile(apart, min(1.0, recall), method="higher")) + 1e-9 if len(apart) else 0.0


def _probe(entries: DataFrame, asked: DataFrame, hashes: Hashes, loss: float, most: int, slices: int, portions: int) -> DataFrame:
    """Rows (_q, _best): for each query and slice the best ``most`` of the candidates, as
    structs of the score with its sign turned (_less) and _id, best first."""
    spark = entries.sparkSession
    part = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = entries.select(part(F.col("_ids")[0], slices).alias("_slice"), each(portions).alias("_portion"), "_ids", "_v")
    queries = asked.select(each(slices).alias("_slice"), part("_q", portions).alias("_portion"), "_q", "_v")
    # by number, as Spark would put small partitions together; more than blocks, so that few share one
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * slices * portions)
    base, queries = (side.repartition(tasks, "_slice", "_portion").groupBy("_slice", "_portion") for side in (base, queries))
    return base.cogroup(queries).applyInArrow(lambda b, q: _search(b, q, hashes, loss, most), "_q bigint, _best array<struct<_less:double,_id:bigint>>")


def _search(base: pa.Table, queries: pa.Table, hashes: Hashes, loss: float, most: int) -> pa.Table:
    """The best of a slice's entries for each of a portion's queries, table by table and bucket
    by bucket: only queries whose loss at a bucket is low enough are compared with what is in it."""
    hit = pa.struct([("_less", pa.float64()), ("_id", pa.int64())])
    schema = pa.schema([("_q", pa.int64()), ("_best", pa.list_(hit))])
    if not base.num_rows or not queries.num_rows:
        return schema.empty_table()
    b, q = _matrix(base.column("_v"), hashes.dim), _matrix(queries.column("_v"), hashes.dim)
    kept: list[tuple] = []
    least = np.full(len(q), -np.inf)  # what a candidate must score
    held = 0

    def compare(some: np.ndarray, rows: np.ndarray, there: np.ndarray, bound: np.ndarray) -> None:
        nonlocal held
        scores = q[some] @ rows.T
        at = np.flatnonzero(scores >= bound[:, None])
        i, j = at // len(there), at % len(there)
        kept.append((some[i], there[j], scores.ravel()[at]))
        held += len(at)

    def sift() -> None:
        nonlocal held
        *best, least[:] = _best(kept, most, len(b), len(q))
        kept[:] = [tuple(best)]
        held = 0

    ids = base.column("_ids").combine_chunks()
    offsets, flat = np.asarray(ids.offsets).astype(np.int64), np.asarray(ids.values)
    first = min(len(b), max(FIRST, most))
    chosen = np.argsort(flat[offsets[:-1]])[:first]  # rows come in any order
    for at in range(0, len(q), max(1, SCORES // first)):
        some = np.arange(at, min(at + max(1, SCORES // first), len(q)))
        scores = q[some] @ b[chosen].T
        last = np.partition(scores, first - min(most, first), axis=1)[:, first - min(most, first)]
        compare(some, b[chosen], chosen, _floor(last))
    sift()
    for t in range(hashes.tables):
        axes = hashes.buckets(b, t)
        order = np.lexsort(axes.T[::-1])
        axes, rows = np.ascontiguousarray(axes[order].T), b[order]
        losses = [np.empty((hashes.n * 2, len(q))) for _ in range(hashes.depth)]
        for at in range(0, len(q), 4096):
            for out, part in zip(losses, hashes.losses(q[at : at + 4096], t)):
                out[:, at : at + 4096] = part.T
        # entries that share their axes so far, with the queries that may still probe them and their losses so far
        open_: list[tuple] = [(0, 0, len(b), np.arange(len(q)), np.zeros(len(q)))]
        while open_:
            j, begin, end, near, spent = open_.pop()
            if j < hashes.depth:
                starts = begin + np.flatnonzero(np.r_[True, np.diff(axes[j, begin:end]) != 0])
                for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), end]):
                    total = spent + losses[j][axes[j, start]][near]
                    fine = np.flatnonzero(total <= loss)
                    if len(fine):
                        open_.append((j + 1, start, stop, near[fine], total[fine]))
                continue
            for low in range(begin, end, 1024):
                high = min(low + 1024, end)
                step = max(1, SCORES // (high - low))
                for at in range(0, len(near), step):
                    some = near[at : at + step]
                    compare(some, rows[low:high], order[low:high], least[some])
                    if held >= HELD:
                        sift()
        sift()
    i, j, _ = kept[0]
    exact = np.concatenate([(q[i[c : c + 65536]] * b[j[c : c + 65536]]).sum(axis=1) for c in range(0, len(i), 65536)] or [np.zeros(0)])
    n = offsets[j + 1] - offsets[j]
    where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[j], n)
    i, exact, found = np.repeat(i, n), np.repeat(exact, n), flat[where]
    by = np.lexsort((found, -exact, i))
    i, exact, found = i[by], exact[by], found[by]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < most
    i, exact, found = i[keep], exact[keep], found[keep]
    begin = np.flatnonzero(np.r_[True, np.diff(i) != 0][: len(i)])
    best = pa.StructArray.from_arrays([pa.array(-exact), pa.array(found)], fields=list(hit))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(i)].astype(np.int32)), best)
    return pa.table([pa.array(np.asarray(queries.column("_q"))[i[begin]]), lists.cast(pa.list_(hit))], schema=schema)


def _floor(score: np.ndarray) -> np.ndarray:
    """What may equal a score: a product's last digits depend on a row's place."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isinf(score), score, score - (1e-9 * np.abs(score) + 1e-12))


def _best(pieces: list, most: int, entries: int, queries: int) -> list[np.ndarray]:
    """Of (query, entry, score) arrays those with a score near or above the query's
    ``most``-th, ties all kept; then what a query's further candidates must score. An entry
    that several tables found counts once."""
    i, j, s = (np.concatenate([p[c] for p in pieces]) for c in range(3))
    once = np.unique(i * entries + j, return_index=True)[1]
    i, j, s = i[once], j[once], s[once]
    order = np.lexsort((-s, i))
    i, j, s = i[order], j[order], s[order]
    first, after = np.searchsorted(i, i), np.searchsorted(i, i, side="right")
    floor = np.where(after - first >= most, _floor(s[np.minimum(first + most, after) - 1]), -np.inf)
    least = np.full(queries, -np.inf)
    least[i] = floor
    keep = s >= floor
    return [i[keep], j[keep], s[keep], least]
