import re

import xxhash

from plotline.llm import simhash as S
from plotline.llm.shared import table

SCHEMA = "doc_id long, text string, fingerprint string, component_id long"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [(i, fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, f"{f:016x}", least.get(find(k))) for k, (i, f) in enumerate(fps)), key=str)


def result(df, **more):
    return sorted((tuple(r) for r in S.near_duplicates(df, **more).collect()), key=str)


def test_whole_table_against_brute_force(spark, tiny):
    docs = table(spark, tiny, "documents")
    assert result(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def near_values():
    """Fingerprints around a few centres, so that chains and dense groups occur."""
    import random

    rng = random.Random(5)
    out = set()
    for centre in [rng.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]:
        for _ in range(60):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def test_links_connect_the_same_with_any_division(spark):
    values = near_values()
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    df = spark.createDataFrame(signed, "_fp long")
    wanted = {}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    for v in values:
        wanted.setdefault(find(v), set()).add(v)
    wanted = sorted(sorted(g) for g in wanted.values() if len(g) > 1)
    for rows in (S.SUBTREE_ROWS, 3):
        got = {}
        for r in S.components(S.fingerprint_links(df, rows)).collect():
            got.setdefault(r["_root"], set()).add(r["_node"] % 2**64)
        assert sorted(sorted(g) for g in got.values()) == wanted


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "one two"), (7, long), (7, long), (8, long + " x"), (None, "ONE"), (None, "other words here now")]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], SCHEMA)
    assert result(df) == brute(rows)
    assert S.near_duplicates(df.limit(0)).count() == 0
