import hashlib
import re

from plotline.llm import decontaminate as D
from plotline.llm.shared import table


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(13, len(v))
            windows = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found.add("null" if item is None else str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(docs, items, **more):
    return sorted((tuple(r) for r in D.contamination_report(D.decontaminate(docs, items, **more)).collect()), key=str)


def test_whole_table_against_brute_force(spark, tiny):
    docs, items = table(spark, tiny, "documents"), table(spark, tiny, "benchmark")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert any(r[5] for r in want)
    assert result(docs, items) == want
    assert result(docs, items, broadcast_rows=0) == want


def test_short_items_overlaps_and_edges(spark):
    line = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(line[:20])), (2, "Alpha"), (3, "beta, gamma"), (4, "one two three four five"), (5, ""), (6, None), (7, " ".join(line[:20])), (8, "rep " * 15), (9, "É é"), (None, "tau tau tau")]
    docs = [
        (1, " ".join(line)), (2, " ".join(line[:12])), (3, "x " * 300 + " ".join(line[5:19])), (4, "alpha BETA gamma; one two three four five"), (5, None), (6, ""),
        (7, "rep " * 40), (8, "é é É é"), (9, "one two three four"), (9, "tau tau tau tau"), (None, "Beta gamma"), (None, "alpha"), (4, "alpha BETA gamma; one two three four five"),
        (10, "y " * 50_000 + "w0 " + " ".join(line[1:14])),
    ]
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, item_id string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert result(d, b) == brute(docs, items)
    assert result(d, b.limit(0)) == brute(docs, [])
    assert result(d.limit(0), b) == []


def test_one_word_again_and_again(spark):
    items = [(1, "na " * 30), (2, "a b " + "na " * 9 + "c d"), (3, "na " * 14 + "end it"), (4, "na na"), (5, "so " + "na " * 20), (6, "x y " * 12)]
    docs = [(i, f"p{i} so " + "na " * n + tail) for i, (n, tail) in enumerate((n, t) for n in (1, 7, 12, 13, 14, 29, 61, 200) for t in ("", "end it now", "c d na na"))]
    docs += [(90, "a b " + "na " * 9 + "c d na"), (91, "x y " * 40 + "z"), (None, "na " * 50), (None, "na " * 50)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(d, b) == brute(docs, items)
    assert result(d, b, broadcast_rows=0) == brute(docs, items)


def test_texts_drawn_at_random(spark):
    import random

    rng = random.Random(4)
    draw = lambda n, m: " ".join(rng.choice("abcd"[:m]) for _ in range(n))
    items = [(i, draw(rng.choice([3, 14, 20, 60]), rng.choice([1, 2, 2]))) for i in range(8)]
    docs = [(i, draw(rng.choice([5, 40, 90]), rng.choice([1, 2, 3])) + " " + rng.choice(items)[1]) for i in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(d, b) == brute(docs, items)
