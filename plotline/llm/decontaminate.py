"""Benchmark decontamination by winnowing.

Both sides keep, of every WINDOW consecutive hashes of K words, the smallest: any shared
span of K + WINDOW - 1 words keeps a common fingerprint at the same place. Fingerprints
are joined, and each hit is extended along its diagonal: the item is laid over the
document at the offset the hit gives, word is compared with word, and runs of equal
words as long as the item's window are occurrences. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.llm.shared import written

#: Words of a window; a shorter item is one window by itself.
SPAN = 13
K = 6
WINDOW = 8
#: Items of fewer than SPAN words are sought by their first words, at most so many.
ANCHOR = 3
#: Up to so many benchmark fingerprints (16 bytes each and item) and bytes of item texts are broadcast;
#: beyond, both sides are shuffled, and the benchmark's rows meet each document in one of SALTS tasks.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
SALTS = 32
#: A document is contaminated if a twentieth of its words or more is hit.
SHARE = 20

#: What lies between words. Texts are split at it: extracting all matches of the words
#: themselves copies the text for each match.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased, other letters as they are; none for null."""

    def lowered(w: Column) -> Column:
        return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))

    return F.transform(raw_words(text), lowered)


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def _later(col: str, by: int) -> Column:
    return F.slice(col, by + 1, F.greatest(F.size(col), F.lit(1)))


def _hashed(df: DataFrame, words: str = "_words") -> DataFrame:
    """``_h1``: a hash for each word."""
    return df.withColumn("_h1", F.transform(words, lambda w: F.xxhash64(w)))


def _grams(df: DataFrame, k: int, out: str) -> DataFrame:
    """``out``: a hash for each k consecutive words, from hashes of 1, 2, 4, ... words.

    Each step is a column of its own, so that it is computed once.
    """
    df, width = df.withColumn(out, F.col("_h1")), 1
    while width < k:
        step = min(width, k - width)
        df = df.withColumn(f"_{out}{width}", F.zip_with(out, _later(out, step), lambda a, b: F.xxhash64(a, b)))
        width += step
        df = df.withColumn(out, F.col(f"_{out}{width - step}")).drop(f"_{out}{width - step}")
    return df.withColumn(out, F.slice(out, 1, F.greatest(F.size(out) - (k - 1), F.lit(0))))


def _spread(df: DataFrame, col: str, window: int, pick) -> DataFrame:
    """``col`` with each value replaced by ``pick`` (least or greatest) of it and the window - 1 after it."""
    width = 1
    while width < window:
        step = min(width, window - width)
        df = df.withColumn(col, F.zip_with(col, _later(col, step), lambda a, b: pick(a, b)))
        width += step
    return df


def _neighbours(kept: Column) -> Column:
    """The array's values with the one before and the one after: structs h, b, a."""
    none = F.array(F.lit(None).cast("bigint"))
    pairs = F.zip_with(kept, F.slice(F.concat(none, kept), 1, F.greatest(F.size(kept), F.lit(1))), lambda h, b: F.struct(h.alias("h"), b.alias("b")))
    after = F.concat(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), none)
    return F.zip_with(pairs, after, lambda p, a: F.struct(p["h"].alias("h"), p["b"].alias("b"), a.alias("a")))


def winnowed(df: DataFrame, k: int, window: int, every: int | None) -> DataFrame:
    """``_kept``: the k-grams of the column ``_h1``, null but for the winnowed ones.

    A k-gram is kept if it is the smallest of some window, which it is if it equals the
    largest of the minima of the windows over it. Of equal minima in a row (one word
    again and again) the first and the last are kept, and, unless
    ``every`` is None, each that lies at a multiple of it. It is enough to thin the items
    to both ends, and the documents to both ends and every ``window``-th: a shared window
    that leaves the run has an end of the run in it, at the same place on both sides; one
    wholly inside is found, from the places kept, by laying the item's run from its start
    at each of them, as the item's run is longer than the steps.
    """
    df = _grams(df, k, "_h")
    df = _spread(df.withColumn("_low", F.col("_h")), "_low", window, F.least)
    # the last window that lies wholly inside; a text of fewer k-grams is one window
    df = df.withColumn("_low", F.slice("_low", 1, F.greatest(F.size("_low") - (window - 1), F.least(F.size("_low"), F.lit(1)))))
    pad = F.array_repeat(F.lit(None).cast("bigint"), window - 1)
    df = df.withColumn("_high", F.concat(pad, F.col("_low"), pad))
    df = _spread(df, "_high", window, F.greatest)
    df = df.withColumn("_kept", F.zip_with("_h", F.slice("_high", 1, F.greatest(F.size("_h"), F.lit(1))), lambda h, m: F.when(h == m, h)))
    step = (lambda i: i % every == 0) if every else (lambda i: F.lit(False))
    ends = lambda g, i: F.when(~g["h"].eqNullSafe(g["b"]) | ~g["h"].eqNullSafe(g["a"]) | step(i), g["h"])
    # few texts have such runs; the others are left as they are
    runs = F.array_contains(F.zip_with("_kept", _later("_kept", 1), lambda a, b: F.coalesce(a == b, F.lit(False))), True)
    return df.withColumn("_runs", runs).withColumn("_kept", F.when(F.col("_runs"), F.transform(_neighbours(F.col("_kept")), ends)).otherwise(F.col("_kept"))).drop("_runs")


def fingerprints(df: DataFrame, keep: list[str], anchors: list[int], k: int = K, window: int = WINDOW, every: int | None = None) -> DataFrame:
    """Rows (keep..., _k, _pos, _hash): the winnowed k-grams of the column ``_h1`` with _k
    0, and, for each of ``anchors``, all grams of so many words with _k that number."""
    df = winnowed(df, k, window, every)

    def numbered(grams: str, n: int) -> Column:
        return F.transform(grams, lambda h, i: F.struct(F.lit(n).alias("k"), i.alias("pos"), h.alias("hash")))

    found = [numbered("_kept", 0)]
    for n in anchors:
        df = _grams(df, n, f"_a{n}")
        found.append(numbered(f"_a{n}", n))
    every_one = F.filter(F.concat(*found), lambda g: g["hash"].isNotNull())
    # the outer form, as a filter inferred below an inner one would repeat the whole chain of columns
    df = df.select(*keep, F.explode_outer(every_one).alias("_g")).where("_g IS NOT NULL")
    return df.select(*keep, F.col("_g.k").alias("_k"), F.col("_g.pos").alias("_pos"), F.col("_g.hash").alias("_hash"))


def find_occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows (_id, _tie, item_id, start, end): runs of document words, end exclusive, each
    word of which lies in an occurrence of one of the item's windows.

    ``_tie`` is a hash of the text: rows of equal or null id are told apart by it.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tie"), F.col(text_col).alias("_text"))
    items = (
        benchmark.select(F.col(item_id_col).alias("item_id"), words_of(F.col(item_text_col)).alias("_item"))
        .where(F.size("_item") > 0)
        .withColumn("_size", F.size("_item"))
    )
    items = written(items, "items")
    lengths = [r[0] for r in items.where(F.col("_size") < span).select(F.least("_size", F.lit(ANCHOR))).distinct().collect()]  # 3 at most

    hashed_items = _hashed(items, "_item")
    wanted = fingerprints(hashed_items.where(F.col("_size") >= span), ["item_id", "_size"], [], K, span - K + 1)
    for k in sorted(lengths):
        short = hashed_items.where((F.col("_size") < span) & (F.least("_size", F.lit(ANCHOR)) == k))
        grams = _grams(short, k, "_first").select("item_id", "_size", F.lit(k).alias("_k"), F.lit(0).alias("_pos"), F.col("_first")[0].alias("_hash"))
        wanted = wanted.unionByName(grams)
    wanted = written(wanted.withColumnsRenamed({"_pos": "_at", "_hash": "_same", "_k": "_length"}), "wanted")
    letters = F.aggregate("_item", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 16)
    small = wanted.count() <= broadcast_rows and (items.agg(F.sum(letters)).first()[0] or 0) <= broadcast_bytes

    def beside(side: DataFrame, left: DataFrame, spread: Column, on: Column) -> DataFrame:
        """``left`` joined to rows of the benchmark: by a broadcast, or with hot keys salted."""
        if small:
            return left.join(F.broadcast(side), on)
        salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = left.withColumn("_spread", F.pmod(spread, F.lit(SALTS)).cast("int"))
        return left.join(salted, on & (F.col("_spread") == F.col("_salt"))).drop("_spread", "_salt")

    hashed = _hashed(rows.withColumn("_words", words_of(F.col("_text"))))
    grams = fingerprints(hashed, ["_id", "_tie"], sorted(lengths), K, span - K + 1, every=span - K + 1)
    hit = beside(wanted, grams, F.xxhash64("_id", "_tie"), (F.col("_hash") == F.col("_same")) & (F.col("_k") == F.col("_length")))
    seeds = hit.select("_id", "_tie", "item_id", "_size", (F.col("_pos") - F.col("_at")).alias("_shift")).distinct()
    per_doc = seeds.groupBy(F.col("_id").alias("_seed_id"), F.col("_tie").alias("_seed_tie")).agg(
        F.collect_list(F.struct("item_id", "_size", "_shift")).alias("_seeds")  # three numbers for each seed of one document
    )
    per_doc = written(per_doc, "seeds")

    # lay each item over its document, one seed a row: the document's words beside the item's, from where both have words
    laid = rows.join(per_doc, F.col("_id").eqNullSafe(F.col("_seed_id")) & (F.col("_tie") == F.col("_seed_tie"))).dropDuplicates(["_id", "_tie"])
    laid = laid.select("_id", "_tie", words_of(F.col("_text")).alias("_all"), "_seeds").select("_id", "_tie", "_all", F.explode_outer("_seeds").alias("_s"))
    begin = F.greatest(F.col("_s._shift"), F.lit(0))
    n = F.greatest(F.least(F.col("_s._shift") + F.col("_s._size"), F.size("_all")) - begin, F.lit(0))
    laid = laid.select(
        "_id", "_tie", F.col("_s.item_id").alias("item_id"), F.col("_s._size").alias("size"), begin.alias("begin"), (begin - F.col("_s._shift")).alias("skip"),
        F.slice("_all", begin + 1, n).alias("words"),
    )
    texts = items.select(F.col("item_id").alias("_own"), F.col("_item"))
    laid = beside(texts, laid, F.xxhash64("_id", "_tie", "begin", "skip"), F.col("item_id").eqNullSafe(F.col("_own")) & (F.size("_item") == F.col("size")))
    marks = F.zip_with("words", F.slice("_item", F.col("skip") + 1, F.size("words")), lambda a, b: F.when(a == b, "1").otherwise("0"))
    runs = F.split(F.array_join(marks, ""), "0", -1)
    start = F.struct(F.col("begin").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def add(acc: Column, run: Column) -> Column:
        end = acc["at"] + F.length(run)
        long = F.length(run) >= F.least(F.col("size"), F.lit(span))
        found = F.when(long, F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["found"])
        return F.struct((end + 1).alias("at"), found.alias("found"))

    found = F.aggregate(runs, start, add, lambda acc: acc["found"])
    return laid.select("_id", "_tie", "item_id", F.explode_outer(found).alias("_run")).where("_run IS NOT NULL").select("_id", "_tie", "item_id", "_run.start", "_run.end")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    share: int = SHARE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, items (sorted ids), spans (start, end in
    words, merged) and contaminated.

    A null text has no words; an item without words is no item. Rows of equal id are
    told apart by their texts; full repetitions are returned each, with the same result.
    Items of equal text all count. A null item id takes part, and is listed last as the
    string ``null``. Empty tables on either side give no hits; other columns are not
    read.
    """
    runs = find_occurrences(docs, benchmark, id_col, text_col, item_id_col, item_text_col, span, broadcast_rows)
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    hits = runs.groupBy(F.col("_id").alias("_hit_id"), F.col("_tie").alias("_hit_tie")).agg(
        F.array_sort(F.collect_set(item)).alias("_items"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_runs")
    )

    def union(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when(
            (F.size(acc) > 0) & (r["start"] <= last["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))
        ).otherwise(F.concat(acc, F.array(r)))

    nothing = F.array().cast("array<struct<start:int,end:int>>")
    hits = hits.select("_hit_id", "_hit_tie", "_items", F.aggregate("_runs", nothing, union).alias("_spans"))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(text_col).alias("_tie"),
        F.size(raw_words(F.col(text_col))).cast("long").alias("n_words"),
    )
    joined = rows.join(hits, F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_tie") == F.col("_hit_tie")), "left")
    spans = F.coalesce("_spans", nothing)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return joined.select(
        F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"), spans.alias("spans")
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def contamination_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``decontaminate``."""
    return found.select(
        F.col(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
