import re

from plotline.llm import licenses as L
from plotline.llm.shared import table

SCHEMA = "doc_id long, text string, score string, findings string"


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def report(df):
    return {r["doc_id"]: r for r in L.license_report(L.scan_licenses(df)).collect()}


def test_whole_table_against_brute_force(spark, tiny):
    docs = table(spark, tiny, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = report(docs)
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text)
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_edges(spark):
    long = "x " * 200_000 + "CC-BY all Rights\nreserved cc by"
    rows = [(1, None, "s", None), (2, "", "s", ""), (3, long, "", ""), (3, long, "", ""), (None, "General (public) LICENSE", None, None), (5, "cc by cc by É", "", "")]
    got = L.license_report(L.scan_licenses(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_words"], by[1]["n_base"], by[1]["first_word"], by[1]["labels"], by[1]["score"]) == (0, 0, None, "", 0.5)
    assert (by[3]["n_base"], by[3]["first_word"], by[3]["base_labels"]) == (3, 200_000, "cc-by,reserved")
    assert by[None]["base_labels"] == "gpl"
    assert (by[5]["n_words"], by[5]["n_base"], by[5]["last_word"]) == (5, 2, 2)
    assert L.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_expressions():
    assert L.to_postfix("MIT OR Apache-2.0 AND BSD") == ["mit", "apache-2.0", "bsd", "and", "or"]
    assert L.to_postfix("(MIT OR GPL-2.0) AND ISC The rest") == ["mit", "gpl-2.0", "or", "isc", "and"]
    assert L.evaluate("GPL-3.0-or-later WITH Classpath-exception-2.0") == (0.5, ["gpl"])
    assert L.evaluate("GPL-2.0-only OR MIT") == (0.9, ["gpl", "mit"])
    assert L.evaluate("GPL-2.0+ AND MIT") == (0.4, ["gpl", "mit"])
    assert L.evaluate("(MIT") is None and L.evaluate("") is None
    assert L.evaluate("MIT OR") == (0.9, ["mit"])


def test_tag_in_text(spark):
    df = spark.createDataFrame([(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0)\ncode")], "doc_id long, text string")
    r = report(df)[1]
    assert r["labels"] == "gpl,mit" and r["score"] == 0.9 and r["n_base"] == 0


def test_many_tags_and_own_terms(spark):
    import time

    assert L.evaluate("CC-BY-NC-SA-4.0")[0] == L.evaluate("CC-BY-NC-ND-4.0")[0] == L.evaluate("LicenseRef-Proprietary")[0] == 0.1
    text = "é x-spdx-license-identifier: no; " + " ".join(f"SPDX-License-Identifier: MIT OR L{i} AND SPDX-License-Identifier: (" for i in range(3000))
    scanner = L.Scanner(L.BASE_PHRASES, L.MORE_PHRASES)
    began = time.time()
    n, found, _ = scanner.scan(text.encode())
    assert time.time() - began < 2 and sum(f[1] == "mit" for f in found) == 3000
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    assert n == len(words) and all(words[at : at + 5] == ["spdx", "license", "identifier", "mit", "or"] for _, label, at, _ in found if label == "mit")
    began = time.time()
    level, labels = L.evaluate(" OR ".join(f"L{i}" for i in range(50_000)))
    assert len(labels) == 50_000 and time.time() - began < 5
    df = spark.createDataFrame([(1, "SPDX-License-Identifier:\nMIT"), (2, "spdx license identifier: MIT"), (3, "SPDX-License-Identifier : CC-BY-NC-SA-4.0")], "doc_id long, text string")
    assert {i: r["labels"] for i, r in report(df).items()} == {1: "", 2: "", 3: "cc-by,cc-by-nc,cc-by-nc-sa"}
