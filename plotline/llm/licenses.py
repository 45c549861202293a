"""Licence scans.

An Aho-Corasick automaton finds notice phrases and identifier tags in the word
sequence of each whole text; the expression behind an identifier tag is parsed by the
shunting-yard method and evaluated: OR takes the more permissive side, AND the
stricter one, WITH adds an exception to a licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.session import ship

# The base phrases of the contract.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
MORE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons": "creative-commons",
    "public domain": "public-domain",
    "open database license": "odbl",
}
TAG_PHRASE = "spdx license identifier"
TAG = re.compile(rb"spdx-license-identifier[ \t]*:")
_RUN = re.compile(rb"[0-9a-z\x80-\xff]+")

#: How freely a text under a licence may be used: 1 is unrestricted, 0 is not at all.
LEVELS = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0,
    "mit": 0.9, "apache": 0.9, "bsd": 0.9, "isc": 0.9, "cc-by": 0.8, "creative-commons": 0.5,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "odbl": 0.5,
    "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "cc-by-nc-nd": 0.1, "cc-by-nc-sa": 0.1, "reserved": 0.0,
}
UNKNOWN_LEVEL = 0.5
#: Licences that are not in the public list, named by their authors.
OWN_TERMS, OWN_LEVEL = "licenseref-", 0.1
EXCEPTION_GAIN = 0.1

_STRENGTH = {"or": 1, "and": 2, "with": 3}
_SYMBOL = re.compile(r"[()\r\n]|[A-Za-z0-9.+:-]+")
_VERSION = re.compile(r"-(?:v?\d[\w.]*)?(?:-?(?:only|or-later|clause|deed))?\+?$|\+$")


def to_postfix(text: str, start: int = 0) -> list[str]:
    """Postfix form of the licence expression at ``start`` of ``text``.

    Reading stops at the end of the line, or at the first symbol that cannot follow, as
    in prose after a tag. A dangling operator is dropped; unbalanced parentheses raise
    ValueError.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for symbol in _SYMBOL.finditer(text, start):
        word = symbol[0].lower()
        if word in "\r\n":
            break
        if operand_next:
            if word == "(":
                waiting.append(word)
            elif word in _STRENGTH or word == ")":
                break
            else:
                out.append(word)
                operand_next = False
        elif word == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                break
            waiting.pop()
        elif word in _STRENGTH:
            while waiting and waiting[-1] != "(" and _STRENGTH[waiting[-1]] >= _STRENGTH[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        else:
            break
    if operand_next and waiting and waiting[-1] != "(":
        waiting.pop()
    while waiting:
        if waiting[-1] == "(":
            raise ValueError("unbalanced parentheses")
        out.append(waiting.pop())
    return out


def family(identifier: str) -> str:
    """An identifier without version: ``gpl-3.0-or-later`` is ``gpl``."""
    name = identifier.lower()
    while (shorter := _VERSION.sub("", name)) != name and shorter:
        name = shorter
    return name


def level_of(label: str) -> float:
    return LEVELS.get(label, OWN_LEVEL if label.startswith(OWN_TERMS) else UNKNOWN_LEVEL)


def evaluate(text: str, start: int = 0) -> tuple[float, list[str]] | None:
    """Level and licence labels, sorted, of the expression at ``start``; None if there is none."""
    try:
        postfix = to_postfix(text, start)
    except ValueError:
        return None
    stack: list[tuple[float, set[str]]] = []
    for symbol in postfix:
        if symbol not in _STRENGTH:
            stack.append((level_of(family(symbol)), {family(symbol)}))
            continue
        right, left = stack.pop(), stack.pop()
        if symbol == "with":
            stack.append((min(1.0, left[0] + EXCEPTION_GAIN), left[1]))
        else:
            # the smaller set goes into the larger, so that long expressions stay cheap
            few, many = sorted((left[1], right[1]), key=len)
            many |= few
            stack.append(((max if symbol == "or" else min)(left[0], right[0]), many))
    return (stack[0][0], sorted(stack[0][1])) if stack else None


#: Every ASCII byte that is no digit or lower-case letter becomes a space.
_SPACED = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Scanner:
    """The automaton over ``phrases`` (phrase to label); ``base`` phrases are counted apart."""

    def __init__(self, base: dict[str, str], more: dict[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        known: dict[str, list] = {}
        for kind, phrases in (("base", base), ("phrase", more), ("tag", {TAG_PHRASE: ""})):
            for phrase, label in phrases.items():
                words = phrase.encode().lower().translate(_SPACED).split()
                key = " " + b" ".join(words).decode("latin-1") + " "
                known.setdefault(key, []).append((kind, label, len(words)))
        for key, hits in known.items():
            self.automaton.add_word(key, hits)
        self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[str, str, int, int]], list[float]]:
        """Number of words, findings (kind, label, first word, words) and levels."""
        lower = (text or b"").lower()
        words = lower.translate(_SPACED).split()
        row = (b" " + b" ".join(words) + b" ").decode("latin-1")
        findings, levels, tags, seen, done = [], [], [], 0, 0
        for end, hits in self.automaton.iter(row):
            done += row.count(" ", seen, end + 1)
            seen = end + 1
            for kind, label, n in hits:
                if kind == "tag":
                    tags.append(done - 1 - n)
                    continue
                findings.append((kind, label, done - 1 - n, n))
                levels.append(level_of(label))
        if tags:
            starts = [m.start() for m in _RUN.finditer(lower)]  # of the words
            plain = lower.decode("latin-1")  # a character for each byte
            for at in tags:
                tag = TAG.match(lower, starts[at])
                if tag and (result := evaluate(plain, tag.end())):
                    findings += [("tag", label, at, 3) for label in result[1]]
                    levels.append(result[0])
        return len(words), findings, levels


FINDING = pa.struct([("kind", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])
SCAN_DDL = "n_words long, findings array<struct<kind:string,label:string,first_word:bigint,n_words:bigint>>, score double"


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] | None = None,
    more: dict[str, str] | None = None,
) -> DataFrame:
    """Per document: id, n_words, findings (kind base, phrase or tag) and score.

    ``score`` is the level of the strictest finding, 0.5 without any. A null text counts
    as empty: no words, no findings. Repeated rows are scanned and returned each; a null
    id is passed on. Other columns of ``docs``, of whatever name, are not read. An empty
    table gives an empty result. Works row by row: no shuffle, and memory for one batch.
    """
    ship(docs.sparkSession)
    base = BASE_PHRASES if base is None else base
    more = MORE_PHRASES if more is None else more
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, more)
        for batch in batches:
            counts, found, scores = [], [], []
            for text in batch.column(1):
                n, findings, levels = scanner.scan(text.as_py())
                counts.append(n)
                found.append([dict(zip(("kind", "label", "first_word", "n_words"), f)) for f in findings])
                scores.append(min(levels, default=UNKNOWN_LEVEL))
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(FINDING)), pa.array(scores, pa.float64())],
                ["_id", "n_words", "findings", "score"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(run, f"_id {id_type}, {SCAN_DDL}").withColumnRenamed("_id", id_col)


def license_report(scans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``scan_licenses``: base places, first and last, labels."""
    base = F.filter("findings", lambda f: f["kind"] == "base")
    starts = F.transform(base, lambda f: f["first_word"])

    def joined(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")

    return scans.select(
        F.col(id_col),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("findings")).alias("labels"),
        "score",
    )
