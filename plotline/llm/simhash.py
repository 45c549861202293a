"""SimHash near-duplicates by a binary trie self-join.

Fingerprints link at BUDGET or fewer differing bits. A trie over the fingerprints'
bits is joined with itself: pairs of nodes are followed down together, each pair
carries the bits in which its paths differ, and is given up beyond the budget.

To spread that over tasks, every distinct fingerprint is entered in BUDGET + 1 tries,
in each of which another block of bits leads. Of two linked fingerprints at least one
block is equal, so it is enough to join, in each trie, the subtree below a whole block
with itself. A subtree of more than SUBTREE_ROWS is divided in the same way by the bits
that are left, into tries led by one of BUDGET + 1 blocks of these, again and again until
all are small enough: a fingerprint in it is copied BUDGET + 1 times, not once for each
node it might meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.llm.shared import forget, join_spread, written
from plotline.session import ship

SHINGLE = 3
BUDGET = 3
BLOCKS = BUDGET + 1
SUBTREE_ROWS = 200_000
#: Pairs of nodes followed at once in a task, and hashes counted at once.
FRONT = 500_000
HASHES = 200_000

GAP = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    def lowered(w: Column) -> Column:
        return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))

    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), ""), lowered)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (_id, _fp): the 64-bit SimHash of the 3-word shingles of the whole text.

    The shingles' XXH64 hashes (seed 42) come from Spark; their bits are counted by Arrow
    batches. A text of fewer words is one shingle; without words the fingerprint is 0.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def later(by: int) -> Column:
        return F.slice("_w", by + 1, F.greatest(F.size("_w"), F.lit(1)))

    rows = docs.select(F.col(id_col).alias("_id"), _words(F.col(text_col)).alias("_w"))
    rows = rows.withColumn("_s", F.zip_with("_w", later(1), lambda a, b: F.concat(a, F.lit(" "), b)))
    rows = rows.withColumn("_s", F.zip_with("_s", later(2), lambda a, b: F.concat(a, F.lit(" "), b)))
    whole = F.when(F.size("_w") > 0, F.array(F.array_join("_w", " "))).otherwise(F.array().cast("array<string>"))
    shingles = F.when(F.size("_w") < SHINGLE, whole).otherwise(F.slice("_s", 1, F.greatest(F.size("_w") - (SHINGLE - 1), F.lit(0))))
    hashed = rows.select("_id", F.transform(shingles, lambda s: F.xxhash64(s)).alias("_h"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.asarray(lists.offsets)
            values = np.asarray(lists.values).view(np.uint64)
            out = np.zeros(len(lists), np.uint64)
            for i, bits in _majorities(values, ends):
                out[i] = bits
            yield pa.record_batch([batch.column(0), pa.array(out.view(np.int64))], ["_id", "_fp"])

    return hashed.mapInArrow(count, f"_id {id_type}, _fp bigint")


def _majorities(values: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows of about HASHES hashes together: the rows and their fingerprints."""
    row, n = 0, len(ends) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + HASHES, "right")) - 1)
        filled = row + np.flatnonzero(np.diff(ends[row : to + 1]))
        if len(filled):
            sums = np.zeros((len(filled), 64), np.int64)
            # one long text is counted in pieces, so that memory stays bounded
            for at in range(ends[filled[0]], ends[to], 4 * HASHES):
                piece = values[at : min(at + 4 * HASHES, ends[to])]
                bits = np.unpackbits(piece.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                if len(filled) == 1:
                    sums[0] += bits.sum(axis=0, dtype=np.int64)
                else:
                    sums += np.add.reduceat(bits, ends[filled] - at, axis=0, dtype=np.int32)
            over = 2 * sums > np.diff(ends)[filled][:, None]
            yield filled, np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
        row = to


class Forest:
    """Union-find over 0..n-1 that takes whole arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def join_trie(low: np.ndarray, front: tuple[np.ndarray, ...], top: int, budget: int, forest: Forest) -> None:
    """Follow pairs of trie nodes down and link the leaves that meet within ``budget``.

    ``low`` holds the values in the order of the trie's leaves, so that a node is a range
    of it. ``front`` has the pairs: begin and end of either node and the bits in which
    their paths differ so far; a node paired with itself stands for its pairs i < j. The
    nodes branch at bit ``top`` next. Pairs wait on a stack in pieces of bounded size.
    """
    ones = {bit: np.concatenate([[0], np.cumsum((low >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]) for bit in range(top + 1)}
    stack = [(top, front)]
    while stack:
        bit, (b1, e1, b2, e2, spent) = stack.pop()
        if len(b1) > FRONT:
            half = len(b1) // 2
            stack += [(bit, tuple(x[:half] for x in (b1, e1, b2, e2, spent))), (bit, tuple(x[half:] for x in (b1, e1, b2, e2, spent)))]
            continue
        same = b1 == b2
        leaves = (e1 - b1 == 1) & (e2 - b2 == 1)
        met = leaves & ~same
        if met.any():
            i, j = b1[met], b2[met]
            near = np.bitwise_count(low[i] ^ low[j]) <= budget
            forest.link(i[near], j[near])
        go = ~leaves
        if bit < 0 or not go.any():
            continue
        b1, e1, b2, e2, spent, same = (x[go] for x in (b1, e1, b2, e2, spent, same))
        c = ones[bit]
        m1, m2 = e1 - (c[e1] - c[b1]), e2 - (c[e2] - c[b2])
        both = ~same
        parts = [(b1, m1, b2, m2, spent), (m1, e1, m2, e2, spent), (b1, m1, m2, e2, spent + 1), (m1[both], e1[both], b2[both], m2[both], spent[both] + 1)]
        below = tuple(np.concatenate(x) for x in zip(*parts))
        keep = (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= budget) & ~((below[0] == below[2]) & (below[1] - below[0] == 1))
        stack.append((bit - 1, tuple(x[keep] for x in below)))


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (_a, _b) of a forest over each subtree's links, subtree by subtree."""
    names = ["_bits", "_trie", "_path", "_low", "_fp"]

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
        bits, trie, path, low, fp = cols
        low = low.astype(np.uint64)
        begin = np.flatnonzero(np.r_[True, (np.diff(bits) != 0) | (np.diff(trie) != 0) | (np.diff(path) != 0)])
        end = np.r_[begin[1:], len(low)]
        forest = Forest(len(low))
        for left in np.unique(bits[begin]):
            own = (bits[begin] == left) & (end - begin > 1)
            b, e = begin[own], end[own]
            if len(b):
                join_trie(low, (b, e, b, e, np.zeros(len(b), np.int64)), int(left) - 1, BUDGET, forest)
        found = np.flatnonzero(forest.root != np.arange(len(low)))
        return pa.record_batch([pa.array(fp[found]), pa.array(fp[forest.root[found]])], ["_a", "_b"])

    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [np.asarray(batch.column(batch.schema.get_field_index(n))) for n in names]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        if not len(cols[0]):
            continue
        last = np.ones(len(cols[0]), bool)
        for c in cols[:3]:
            last &= c == c[-1]
        cut = len(last) - int(last.sum())  # the last subtree's rows may go on in the next batch
        rest = [c[cut:] for c in cols]
        if cut:
            yield edges([c[:cut] for c in cols])
    if rest is not None and len(rest[0]):
        yield edges(rest)


def _deeper(rows: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """Each row of subtrees with ``bits`` bits left, in BLOCKS tries led by another block
    of these bits, and the bits then left."""
    block, low = bits // BLOCKS, F.col("_low")

    def rotated(by: int) -> Column:
        turned = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, bits - by)) if by else low
        return turned.bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else turned

    tries = F.array(*[F.struct(F.lit(t).alias("t"), rotated(t * block).alias("v")) for t in range(BLOCKS)])
    rows = rows.select("_fp", "_trie", "_path", F.explode(tries).alias("_t"))
    left = bits - block
    rows = rows.select(
        "_fp",
        (F.col("_trie") * BLOCKS + F.col("_t.t")).alias("_trie"),
        F.shiftleft("_path", block).bitwiseOR(F.shiftrightunsigned("_t.v", left)).alias("_path"),
        F.col("_t.v").bitwiseAND(F.lit((1 << left) - 1)).alias("_low"),
    )
    return rows, left


def fingerprint_links(distinct: DataFrame, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """Edges (_a, _b) between the distinct fingerprints of the column _fp, enough to
    connect all that the links connect: a forest for each subtree, not all pairs."""
    whole = distinct.select("_fp", F.lit(0).alias("_trie"), F.lit(0).cast("bigint").alias("_path"), F.col("_fp").alias("_low"))
    rows, bits = _deeper(whole, 64)
    subtree = ["_trie", "_path"]
    parts: DataFrame | None = None
    while True:
        large = rows.groupBy(*subtree).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > subtree_rows).select(*subtree)
        large = written(large, "large")  # at most a row for each ``subtree_rows`` rows
        more = bits >= 2 * BLOCKS and bool(large.take(1))
        kept = rows.join(F.broadcast(large), subtree, "left_anti") if more else rows
        kept = kept.withColumn("_bits", F.lit(bits))
        parts = kept if parts is None else parts.unionByName(kept)
        if not more:
            break
        rows, bits = _deeper(rows.join(F.broadcast(large), subtree, "left_semi"), bits)
    task = ["_bits", *subtree]
    return parts.repartition(*task).sortWithinPartitions(*task, "_low").mapInArrow(_linked, "_a bigint, _b bigint")


def components(edges: DataFrame) -> DataFrame:
    """Rows (_node, _root) for every node with an edge, _root the smallest node connected.

    Each round a node takes the least label of its neighbours and itself, then the label
    of that label. Rounds end when no label changes; each is written, as lineage would
    grow otherwise.
    """
    both = written(edges.select("_a", "_b").unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("_a").alias("_node")).agg(F.least(F.min("_b"), F.col("_a")).alias("_root")), "labels")
    while True:
        near = both.join(labels, F.col("_b") == F.col("_node")).groupBy("_a").agg(F.min("_root").alias("_near"))
        stepped = labels.join(near, F.col("_node") == F.col("_a")).select("_node", F.least("_root", "_near").alias("_next"), F.col("_root").alias("_was"))
        up = labels.select(F.col("_node").alias("_n"), F.col("_root").alias("_up"))
        jumped = stepped.join(up, F.col("_next") == F.col("_n")).select("_node", F.least("_next", "_up").alias("_root"), "_was")
        after = written(jumped, "labels")
        changed = bool(after.where("_root <> _was").take(1))
        forget(labels)
        labels = after
        if not changed:
            return labels.select("_node", "_root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """Per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id whose fingerprint can be reached by links, the row's
    own included. Null and empty texts, and those without words, have fingerprint zero
    and link like any other. Repeated rows are returned each; a null id is no candidate
    for component_id, which is null only if no id of the component is known. An empty
    table gives an empty result; other columns are not read. Copies share a fingerprint
    and are one leaf of the tries, however many they are.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    leaves = written(rows.groupBy("_fp").agg(F.min("_id").alias("_first")), "leaves")
    edges = written(fingerprint_links(leaves.select("_fp"), subtree_rows), "links")
    grouped = components(edges).join(leaves, F.col("_node") == F.col("_fp")).select("_fp", "_root", "_first")
    named = grouped.groupBy(F.col("_root").alias("_r")).agg(F.min("_first").alias("_least"))
    named = grouped.join(named, F.col("_root") == F.col("_r")).select(F.col("_fp").alias("_linked"), "_least")
    classes = leaves.join(named, F.col("_fp") == F.col("_linked"), "left").select(
        "_fp", F.when(F.col("_linked").isNull(), F.col("_first")).otherwise(F.col("_least")).alias("_class")
    )
    return join_spread(rows, written(classes, "classes"), "_fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_class").alias("component_id")
    )
