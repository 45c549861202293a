"""Spelling variants by two-dimensional range reporting.

Words are near if one inserted, deleted or replaced character makes them equal. For an
edit at place i of a word, all that is left of it is a prefix and all that is right of it
a suffix of the other word: words with the prefix are an interval of the forward order,
words with the suffix an interval of the order of reversed words, and a word in both is a
point of a grid that maps one order to the other. A wavelet tree over that permutation
reports the points of a rectangle without looking at the others.

To spread that over tasks, the places are halved: words that are near by an edit in the
back half share their front half, and the other way round, so that only words with an
equal half meet. A group of more than GROUP_ROWS words is halved again, by what its
places leave equal, until groups are small; what shares all but one place is at most an
alphabet. A deletion is an insertion seen from the other word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.llm.shared import forget, written
from plotline.session import ship

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent as the word.
FORM_TIMES = 5
#: Where this divides the checksum of id and run, the run loses a letter.
THINNED = 199

GROUP_ROWS = 50_000
#: A task works on whole groups of about so many words, or characters, at once.
CHUNK_ROWS, CHUNK_CHARS = 100_000, 8_000_000
#: Rectangles followed at once, words and characters counted at once.
FRONT = 500_000
COUNTED, PIECE = 300_000, 1 << 22

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _runs(text: str) -> Iterator[Counter]:
    """Counts of the lower-cased runs of letters, for pieces of the text that cut no run."""
    at = 0
    while at < len(text):
        to = len(text)
        if to - at > PIECE and (gap := _GAP.search(text, at + PIECE)):
            to = gap.start()
        yield Counter(_RUN.findall(text[at:to].translate(_LOWER)))
        at = to


def thinned(run: str, seed: int) -> str:
    """The run, without one letter where its checksum says so; ``seed`` is that of its id."""
    h = zlib.crc32(run.encode(), seed)
    if h % THINNED:
        return run
    return run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (_w, _n): words of at least LEAST_LETTERS letters and how often they occur."""
    ship(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        chars = 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = zlib.crc32(f"{name}:".encode())
                for counts in _runs(text.as_py()):
                    for run, n in counts.items():
                        if len(run) >= LEAST_LETTERS:
                            word = thinned(run, seed)
                            if word in found:
                                found[word] += n
                            elif len(word) >= LEAST_LETTERS:
                                found[word] = n
                                chars += len(word)
                    if len(found) > COUNTED or chars > PIECE:
                        yield _columns(["_w", "_n"], list(found), list(found.values()))
                        found, chars = {}, 0
        yield _columns(["_w", "_n"], list(found), list(found.values()))

    texts = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col(text_col).alias("_t"))
    return texts.mapInArrow(count, "_w string, _n bigint").groupBy("_w").agg(F.sum("_n").alias("_n"))


def _columns(names: list[str], words: list[str], *numbers: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(words, pa.string()), *[pa.array(n, pa.int64()) for n in numbers]], names)


# ---- groups that share a half -----------------------------------------------------------


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice, with either half of its places and the group that it then is in.

    ``_s`` is 0 for replacements and 1 for insertions, ``_l`` the length of the word that
    asks. Places i in [_lo, _hi) leave its first _lo characters and, from the end, all
    behind _hi - 1 (behind the gap before it, for insertions) as they are.
    """
    middle = F.expr("div(_lo + _hi, 2)")
    halves = F.array(*[F.struct(lo.alias("lo"), hi.alias("hi")) for lo, hi in ((F.col("_lo"), middle), (middle, F.col("_hi")))])
    rows = rows.select("_w", "_n", "_s", "_l", F.explode(halves).alias("_h")).where("_h.lo < _h.hi")
    rows = rows.select("_w", "_n", "_s", "_l", F.col("_h.lo").alias("_lo"), F.col("_h.hi").alias("_hi"))
    behind = F.col("_l") - F.col("_hi") + F.col("_s")
    shared = F.struct(F.substring(F.col("_w"), F.lit(1), F.col("_lo")), F.when(behind > 0, F.substring(F.col("_w"), -behind, behind)).otherwise(""))
    return rows.withColumn("_g", F.xxhash64(shared))


def near_counts(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per word (_w) with near words among ``words`` (_w, _n): _near, how many, and _best
    (n, word), that of largest n, ties to the smaller word."""
    ship(words.sparkSession)
    length = F.length("_w")
    kinds = [(0, length, length), (1, length, length + 1), (1, length - 1, length)]
    entries = F.array(*[F.struct(F.lit(s).alias("s"), asks.cast("int").alias("l"), hi.cast("int").alias("hi")) for s, asks, hi in kinds])
    rows = words.select("_w", "_n", F.explode(entries).alias("_e")).where("_e.l > 0")
    rows = _halved(rows.select("_w", "_n", F.col("_e.s").alias("_s"), F.col("_e.l").alias("_l"), F.lit(0).alias("_lo"), F.col("_e.hi").alias("_hi")))
    group = ["_s", "_l", "_lo", "_hi", "_g"]
    parts: DataFrame | None = None
    while True:
        large = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_many")).where((F.col("_many") > group_rows) & (F.col("_hi") - F.col("_lo") > 1)).select(*group)
        large = written(large, "large-groups")  # at most a row for each ``group_rows`` rows
        more = bool(large.take(1))
        kept = rows.join(F.broadcast(large), group, "left_anti").select("_w", "_n", *group) if more else rows
        parts = kept if parts is None else parts.unionByName(kept)
        if not more:
            break
        rows = _halved(rows.join(F.broadcast(large), group, "left_semi"))
    found = parts.repartition(*group).sortWithinPartitions(*group).select("_w", "_n", *group).mapInArrow(_reported, "_w string, _near bigint, _top bigint, _with string")
    best = F.min(F.struct((-F.col("_top")).alias("less"), F.col("_with").alias("word")))
    return found.groupBy("_w").agg(F.sum("_near").alias("_near"), best.alias("_b")).select("_w", "_near", F.struct((-F.col("_b.less")).alias("n"), F.col("_b.word").alias("word")).alias("_best"))


# ---- one task's words -------------------------------------------------------------------


def _reported(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words within the groups, which come in order, some whole groups at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        got = pa.Table.from_batches([batch])
        rest = got if rest is None else pa.concat_tables([rest, got])
        if len(rest) > CHUNK_ROWS or rest.nbytes > CHUNK_CHARS:
            keys = [rest.column(i).to_numpy() for i in range(2, 7)]
            first = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
            cut = int(first[-1]) + 1 if len(first) else 0  # the last group may go on
            yield from _by_places(rest.slice(0, cut))
            rest = rest.slice(cut).combine_chunks()
    if rest is not None:
        yield from _by_places(rest)


def _by_places(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Groups with the same lengths and places can be searched together: their words
    differ in what the members of a group share."""
    if not len(rows):
        return
    keys = [rows.column(i).to_numpy() for i in range(2, 6)]
    begin = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    for b, e in zip(begin, [*begin[1:], len(rows)]):
        s, asks, lo, hi = (int(k[b]) for k in keys)
        own = rows.slice(b, e - b)
        counts = own.column(1).to_numpy()
        found = search(own.column(0).to_pylist(), counts, s, asks, lo, hi)
        if found is not None:
            yield _columns(["_w", "_near", "_top"], *found[:3]).append_column("_with", pa.array(found[3], pa.string()))


def _letters(words: list[str], length: int) -> np.ndarray:
    """One row a word, one byte a character: runs hold no character beyond U+00FF."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


class Order:
    """Words in order, and where those with a common beginning begin and end.

    ``rows`` are words as bytes, filled up with zeros; ``counts`` marks those that are
    points of the grid, and places are given in numbers of points.
    """

    def __init__(self, rows: np.ndarray, points: np.ndarray):
        width = rows.shape[1]
        self.order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
        ordered = rows[self.order]
        unlike = ordered[1:] != ordered[:-1]
        self.common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
        self.place = np.empty(len(rows), np.int64)
        self.place[self.order] = np.arange(len(rows))
        self.before = np.concatenate([[0], np.cumsum(points[self.order])])

    def interval(self, depth: int, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end, among the points, of the words that begin with the same ``depth``
        characters as each of ``asking``."""
        starts = np.concatenate([[0], np.flatnonzero(self.common < depth) + 1])
        at = np.searchsorted(starts, self.place[asking], "right") - 1
        ends = np.append(starts[1:], len(self.order))
        return self.before[starts[at]], self.before[ends[at]]


class WaveletTree:
    """A permutation, as bits from the highest down; each level is in the order of the
    bits above it, and counts the ones up to each place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            ranks = np.concatenate([[0], np.cumsum(ones)])
            self.levels.append((ranks, len(values) - int(ranks[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    def report(self, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (rectangle, value): values of [low, high) at places of [begin, end).

        All rectangles go down together, in pieces of at most FRONT that wait on a stack;
        a branch ends where it has no places or none of its values is asked for.
        """
        stack = [(0, np.arange(len(begin)), begin, end, np.zeros(len(begin), np.int64))]
        while stack:
            level, who, b, e, value = stack.pop()
            if len(who) > FRONT:
                half = len(who) // 2
                stack += [(level, *(x[cut] for x in (who, b, e, value))) for cut in (slice(half), slice(half, None))]
                continue
            if level == self.bits:
                yield who, value
                continue
            ranks, zeros = self.levels[level]
            b1, e1 = ranks[b], ranks[e]
            size = 1 << (self.bits - 1 - level)
            parts = ((b - b1, e - e1, value), (zeros + b1, zeros + e1, value + size))
            who, b, e, value = (np.concatenate(x) for x in zip(*[(who, *p) for p in parts]))
            go = (b < e) & (value < high[who]) & (value + size > low[who])
            if go.any():
                stack.append((level + 1, who[go], b[go], e[go], value[go]))


def search(words: list[str], counts: np.ndarray, s: int, asks: int, lo: int, hi: int) -> tuple | None:
    """Words with near words among ``words``, by edits at places of [lo, hi): words, how
    many, largest count, word of that count (ties: the smallest).

    ``s`` is 0 for replacements in words of ``asks`` characters, and 1 for insertions
    into these that give the words one longer.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.flatnonzero(lengths == asks + s)
    asking = np.flatnonzero(lengths == asks)
    if not len(points) or not len(asking) or (s == 0 and len(points) < 2):
        return None
    width = asks + s
    forward, backward = np.zeros((2, len(words), width), np.uint8)
    for own in [points] if s == 0 else [points, asking]:
        letters = _letters([words[i] for i in own], int(lengths[own[0]]))
        forward[own, : letters.shape[1]] = letters
        backward[own, : letters.shape[1]] = letters[:, ::-1]
    is_point = lengths == width
    front, back = Order(forward, is_point), Order(backward, is_point)
    in_front, in_back = front.order[is_point[front.order]], back.order[is_point[back.order]]
    rank = np.empty(len(words), np.int64)
    rank[in_back] = np.arange(len(points))
    tree = WaveletTree(rank[in_front])
    priority = np.empty(len(words), np.int64)
    by = np.lexsort((front.place, -counts))  # by falling count, then by word
    priority[by] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for i in range(lo, hi):
        f1, f2 = front.interval(i, asking)
        r1, r2 = back.interval(asks - i - 1 + s, asking)
        # of replacements the word itself is in both intervals
        wide = np.flatnonzero((f2 - f1 > 1 - s) & (r2 - r1 > 1 - s))
        for who, value in tree.report(*(x[wide] for x in (f1, f2, r1, r2))):
            one, other = asking[wide[who]], in_back[value]
            if s == 0:
                real = one != other
            else:  # of equal letters in a row the first counts as inserted
                real = forward[one, i - 1] != forward[other, i] if i else np.ones(len(one), bool)
            one, other = one[real], other[real]
            for a, b in [(one, other)] if s == 0 else [(one, other), (other, one)]:
                near += np.bincount(a, minlength=len(words))
                np.minimum.at(best, a, priority[b])
    some = np.flatnonzero(near)
    if not len(some):
        return None
    with_ = by[best[some]]
    return [words[i] for i in some], near[some], counts[with_], [words[i] for i in with_]


# ---- forms and roots --------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """Rows (_w, _root) for rows (_w, _form): the end of the chain of forms. Each round a
    word takes the form of its form, so that what is left of a chain halves; counts grow
    FORM_TIMES-fold along a chain, which bounds it."""
    at = written(forms.select("_w", F.col("_form").alias("_root")), "roots")
    while True:
        up = at.select(F.col("_w").alias("_u"), F.col("_root").alias("_up"))
        stepped = at.join(up, F.col("_root") == F.col("_u"), "left").select("_w", F.coalesce("_up", "_root").alias("_root"), F.col("_up").isNotNull().alias("_moved"))
        after = written(stepped, "roots")
        moved = bool(after.where("_moved").take(1))
        forget(at)
        at = after
        if not moved:
            return at.select("_w", "_root")


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words are those of LEAST_LETTERS or more letters that occur LEAST_COUNT or more times
    in all rows. Null and empty texts have none; a null id counts as an empty one where
    letters are left out. Repeated rows count each; texts and words of any length are
    taken whole. A word without near words has n_near 0, one without a form null form and
    form_n and itself as root. An empty table gives an empty result; other columns are
    not read.
    """
    words = written(word_counts(docs, id_col, text_col).where(F.col("_n") >= LEAST_COUNT), "words")
    near = near_counts(words, group_rows)
    has: Column = F.col("_best.n") >= FORM_TIMES * F.col("_n")
    found = words.join(near, "_w", "left").select("_w", "_n", F.coalesce("_near", F.lit(0)).alias("_near"), F.when(has, F.col("_best")).alias("_form"))
    found = written(found, "near-words")
    ends = roots(found.where(F.col("_form").isNotNull()).select("_w", F.col("_form.word").alias("_form")))
    return found.join(ends, "_w", "left").select(
        F.col("_w").alias("word"), F.col("_form.word").alias("form"), F.coalesce("_root", "_w").alias("root"), F.col("_n").alias("n"), F.col("_near").alias("n_near"), F.col("_form.n").alias("form_n")
    )
