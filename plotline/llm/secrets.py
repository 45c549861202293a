"""Secret scans with an incremental blob ledger.

Every version of every document is addressed by the SHA-256 of its text. The ledger
holds one row for each blob and rule version that was scanned, with its findings; a
run scans only the pairs the ledger lacks, adds them, and joins the findings back to
all paths of a blob. DataFrame functions only.

The pass that addresses the texts also looks for the marks without which no rule can
match; a blob without any is entered in the ledger with no findings, and its text never
moves. Only texts with a mark are carried to the scan, each blob once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.llm.shared import join_spread, shared_folder, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` is matched leftmost and non-overlapping, matches whose
    ``group`` has fewer than ``least`` characters are dropped. ``marks`` are strings of
    which every match holds one, in lower case in the lower-cased text; a rule without
    marks has its pattern for one."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    marks: tuple[str, ...] = ()


# The base kinds of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    # greedy runs of 16 or more are the runs of any length that are not dropped
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    Rule("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", marks=("private key-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", marks=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", marks=("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", marks=("eyj",)),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "struct<start:bigint,ord:int,end:bigint,kind:string>"


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches as an array of (start, ord, end, kind), in code points.

    Text split at the pattern gives the gaps; a match starts where the gaps and matches
    before it end.
    """
    pattern = F.lit(rule.pattern)
    match = F.zip_with(
        F.zip_with(
            F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), 1, F.regexp_count(text, pattern)),
            F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length),
            lambda gap, n: F.struct(gap.alias("gap"), n.alias("n")),
        ),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length),
        lambda a, value: F.struct(a["gap"].alias("gap"), a["n"].alias("n"), value.alias("value")),
    )
    nothing = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), nothing.alias("found"))

    def add(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), (begin + m["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
        found = F.when(m["value"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct((begin + m["n"]).alias("at"), found.alias("found"))

    return F.when(text.rlike(rule.pattern), F.aggregate(match, start, add, lambda acc: acc["found"])).otherwise(nothing)


def marked(text: Column, lower: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether any rule could match. ``lower`` is the text in lower case."""
    out = F.lit(False)
    for mark in dict.fromkeys(m for rule in rules for m in rule.marks):
        out = out | F.contains(lower, F.lit(mark))
    for rule in rules:
        if not rule.marks:
            out = out | text.rlike(rule.pattern)
    return out


def version_of(rules: tuple[Rule, ...]) -> str:
    """A name for what the rules find: it changes with any of them, and with their order."""
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()[:16]


def text_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules' matches in one array, by start, then by the order of the rules."""
    return F.array_sort(F.concat(*[rule_spans(text, rule, i) for i, rule in enumerate(rules)]))


def _batches(spark: SparkSession, folder: str) -> list[str]:
    """The batches of a ledger's rule version that were written to their end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(str(f.getPath().getParent()) for f in found or [])


def read_ledger(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (blob, spans) of all blobs scanned by these rules, each once."""
    schema = f"blob string, spans array<{SPAN}>"
    batches = _batches(spark, f"{ledger}/{version_of(rules)}")
    if not batches:
        return spark.createDataFrame([], schema)
    # two runs at once may both have scanned a blob, with equal results
    return spark.read.schema(schema).parquet(*batches).groupBy("blob").agg(F.first("spans").alias("spans"))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    ledger: str | None = None,
) -> DataFrame:
    """Per row of ``docs``: id, blob and spans (start, ord, end, kind) of its text.

    ``ledger`` is the folder of the ledger; blobs that it holds for these very rules are
    not scanned again, and findings of other rules are not seen. Each run adds a batch,
    a folder of its own that counts once Spark has marked it complete, so that a failed
    run leaves nothing behind that is read. Without ``ledger``, the run starts an empty
    one in the shared folder.

    Null texts count as empty and share the blob of the empty text; rows with equal
    texts share a blob and get the same spans; repeated rows and null ids are returned
    each. An empty table gives an empty result; other columns are not read. A blob is
    scanned once, however many rows have it: of its rows those with the smallest hash of
    the id are told apart from the others before texts move, and equal ones of these are
    made one in the tasks that read them.
    """
    spark = docs.sparkSession
    ledger = ledger or f"{shared_folder(spark)}/plotline/ledger-{uuid4().hex}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    rows = rows.withColumns({"_blob": F.sha2(F.col("_text").cast("binary"), 256), "_low": F.lower("_text"), "_salt": F.xxhash64("_id")})
    paths = rows.select("_id", "_salt", "_blob", F.when(marked(F.col("_text"), F.col("_low"), rules), F.col("_text")).alias("_marked"))
    paths = written(paths, "paths")

    blobs = paths.groupBy("_blob").agg(F.min("_salt").alias("_first"), F.bool_or(F.col("_marked").isNotNull()).alias("_any"))
    known = read_ledger(spark, ledger, rules).select(F.col("blob").alias("_blob"))
    unseen = written(blobs.join(known, "_blob", "left_anti"), "unseen")
    wanted = unseen.where("_any").select("_blob", F.col("_first").alias("_salt"))
    texts = paths.where("_marked IS NOT NULL").groupBy("_salt", "_blob").agg(F.first("_marked").alias("_text"))
    texts = texts.join(wanted, ["_salt", "_blob"], "left_semi")
    nothing = F.array().cast(f"array<{SPAN}>")
    scanned = texts.select(F.col("_blob").alias("blob"), text_spans(F.col("_text"), rules).alias("spans"))
    scanned = scanned.unionByName(unseen.where("NOT _any").select(F.col("_blob").alias("blob"), nothing.alias("spans")))
    scanned.write.parquet(f"{ledger}/{version_of(rules)}/{uuid4().hex}")

    found = read_ledger(spark, ledger, rules).where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    return join_spread(paths.select("_id", "_blob"), found, "_blob").select(F.col("_id").alias(id_col), F.col("_blob").alias("blob"), F.coalesce("_spans", nothing).alias("spans"))


def secret_report(scans: DataFrame, id_col: str = "doc_id", base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The contract's columns from ``scan_secrets``."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scans.select(
        F.col(id_col),
        *[count(rule.kind) for rule in base],
        F.sha2(joined(F.filter("spans", lambda s: s["ord"] < len(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the
    first is named and the rest of the others is removed with it."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("<"), s["kind"], F.lit(">")))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), gap.alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    )
