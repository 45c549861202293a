import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plotline.llm import spelling as S
from plotline.llm.shared import table

SCHEMA = "doc_id long, text string, word string, n int, _w string"
LETTERS = "abcdé"


def counted(rows):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def edited(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}) - {word}


def brute(words):
    letters = sorted({c for w in words for c in w})
    near = {w: [o for o in edited(w, letters) if o in words] for w in words}
    best = {w: min(o, key=lambda x: (-words[x], x)) if o else None for w, o in near.items()}
    form = {w: b if b and words[b] >= 5 * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def result(df, **more):
    return sorted(tuple(r) for r in S.group_spellings(df, **more).collect())


def test_whole_table_against_brute_force(spark, tiny):
    docs = table(spark, tiny, "documents")
    expected = brute(counted((r["doc_id"], r["text"]) for r in docs.collect()))
    assert result(docs) == expected
    assert any(r[1] for r in expected) and any(r[4] > 1 for r in expected)


@pytest.mark.parametrize("group_rows", [50_000, 40, 3])
def test_dense_words_in_split_groups(spark, group_rows):
    rng = random.Random(3)
    stems = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(6, 10))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "abababab"]
    words = set(stems)
    for _ in range(2):
        words |= {rng.choice(sorted(edited(w, LETTERS))) for w in sorted(words) for _ in range(4)}
    words = {w: 5 ** rng.randrange(1, 6) + rng.randrange(3) for w in words if len(w) >= 6}
    frame = spark.createDataFrame(list(words.items()), "_w string, _n long").repartition(3)
    found = {r["_w"]: (r["_near"], r["_best"]["n"], r["_best"]["word"]) for r in S.near_counts(frame, group_rows).collect()}
    expected = {w: [o for o in edited(w, LETTERS) if o in words] for w in words}
    assert found == {w: (len(o), max(words[x] for x in o), min(o, key=lambda x: (-words[x], x))) for w, o in expected.items() if o}


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = S.WaveletTree(values)
        b, lo = rng.integers(0, n, (2, 50))
        e, hi = np.minimum(n, b + rng.integers(0, n + 1, 50)), np.minimum(n, lo + rng.integers(0, n + 1, 50))
        found = sorted((int(w), int(v)) for who, value in tree.report(b, e, lo, hi) for w, v in zip(who, value))
        assert found == sorted((k, int(v)) for k in range(50) for v in values[b[k] : e[k]] if lo[k] <= v < hi[k])


def test_pieces_of_work_do_not_change_it(spark, tiny, monkeypatch):
    docs = table(spark, tiny, "documents").limit(40)
    words = sorted(counted((r["doc_id"], r["text"]) for r in docs.collect()).items())
    frame = spark.createDataFrame(words, "_w string, _n long")
    batches = [b for b in frame.toArrow().to_batches(100)]
    rows = [(w, n, 0, len(w), 0, len(w), 0) for w, n in words if len(w) == 8]
    import pyarrow as pa

    cols = list(zip(*rows))
    whole = pa.record_batch([pa.array(c) for c in cols], ["_w", "_n", "_s", "_l", "_lo", "_hi", "_g"])
    one = [t for b in S._reported([whole]) for t in b.to_pylist()]
    monkeypatch.setattr(S, "FRONT", 3)
    assert batches and one == [t for b in S._reported([whole.slice(0, 5), whole.slice(5)]) for t in b.to_pylist()]


def test_texts_cut_where_no_run_is(monkeypatch):
    text = "Alpha béta " * 50 + "x" * 300 + " Alpha"
    monkeypatch.setattr(S, "PIECE", 64)
    assert sum(S._runs(text), Counter()) == {"alpha": 51, "béta": 50, "x" * 300: 1}


def test_odd_rows(spark):
    long_word = "q" * 3000
    rows = [(1, None), (2, ""), (None, "Colour colour COLOUR colour colour"), (3, "color colors color colors color colors " * 30), (4, "99 -- 中文中文中文 ñandúes " * 5)]
    rows += [(5, f"{long_word} {long_word}z " * 5), (6, "short five5 a b"), (3, "color colors color colors color colors " * 30)]
    frame = spark.createDataFrame([(i, t, "w", 1, "x") for i, t in rows], SCHEMA)
    found = result(frame)
    assert found == brute(counted(rows))
    by = {r[0]: r for r in found}
    assert by["colour"][4] == 0 and by[long_word][4] == 1 and by["ñandúes"][2] == "ñandúes"


def test_chains_end_at_their_root(spark):
    steps = [("wandern", 5), ("wandera", 25), ("wanders", 0), ("wanderas", 125), ("wandereas", 625)]
    rows = [(100 + k, f"{w} " * n) for k, (w, n) in enumerate(steps)]
    kept = counted(rows)
    found = result(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA))
    assert found == brute(kept)
    assert {r[0]: r[2] for r in found}["wandern"] == "wandereas"


def test_empty_table(spark):
    df = S.group_spellings(spark.createDataFrame([], SCHEMA))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and not df.collect()
