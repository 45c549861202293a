"""URL filters: rules by host and path, and link-graph propagation for hosts without one.

Trust flows from hosts that the rules mostly allow along the links (personalised
PageRank); distrust flows from hosts that they mostly block against the links, so that
a host which links to blocked ones is distrusted. A host is blocked where its distrust
outweighs its trust by more than a threshold. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.llm.shared import HOT_ROWS, forget, join_spread, written

# The contract's rules, as (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DAMPING = 0.85
#: Rounds end when the changes of all hosts' scores, added up and times the number of hosts
#: (as the threshold is), are less than this.
TOLERANCE = 1e-5
#: A host is blocked if its distrust exceeds its trust by more than this share of the mean score.
THRESHOLD = 0.2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits (host + path), as a struct (rule, verdict), or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0], r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def host_scores(pages: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Trust and distrust per host, each adding up to 1 if it has a seed.

    ``pages`` has a row per host with the seed flags _good and _bad; ``edges`` (src,
    dst, n) counts the links between hosts. Both flows are one iteration over rows
    (kind, host, score); what hosts without a way out hold returns to the seeds. State
    is written each round, so that lineage stays short; rows are hosts, not pages.

    There are ``rounds`` rounds, or, if that is None, as many as it takes until a round
    changes the scores by less than ``tolerance``. A round lessens the sum of changes by
    the damping at least, so the rounds grow with the logarithm of the hosts, and no
    score is further from the settled one than damping / (1 - damping) times the last change.
    """
    seeds = pages.select(F.col("_host").alias("host"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("seed")) for k, c in (("trust", "_good"), ("distrust", "_bad"))])).alias("s"))
    seeds = seeds.select("host", "s.kind", "s.seed")
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("total"))  # two rows
    seeds = written(
        seeds.join(F.broadcast(total), "kind").select("kind", "host", F.when(F.col("total") > 0, F.col("seed") / F.col("total")).otherwise(0.0).alias("seed")), "seeds"
    )
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    )
    ways = written(ways.withColumn("_from", F.struct("kind", "a")), "ways")
    if not ways.take(1):
        return _by_host(seeds.withColumnRenamed("seed", "score"))
    # the links of a host with very many are dealt to several tasks, as many as its fan
    out = ways.groupBy("_from").agg(F.sum("n").alias("all"), F.ceil(F.count(F.lit(1)) / HOT_ROWS).cast("int").alias("fan"))
    out = written(out, "out")
    ways = join_spread(ways, out, "_from").select("kind", "a", "b", (F.col("n") / F.col("all")).alias("share"), F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("turn"))
    ways = written(ways, "shares")
    fans = out.select(F.col("_from.kind").alias("kind"), F.col("_from.a").alias("host"), "fan")
    state = seeds.join(fans, ["kind", "host"], "left").select("kind", "host", "seed", F.coalesce("fan", F.lit(1)).alias("fan"), F.col("seed").alias("score"))
    state = written(state, "state")
    enough = tolerance / max(1, pages.count())
    previous, done = None, 0
    while rounds is None or done < rounds:
        flow = (
            state.select(F.col("kind").alias("_kind"), "host", "score", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("_turn"))
            .join(ways, (F.col("_kind") == F.col("kind")) & (F.col("host") == F.col("a")) & (F.col("_turn") == F.col("turn")))
            .groupBy("_kind", "b")
            .agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
        )
        moved = flow.groupBy("_kind").agg(F.sum("flow").alias("moved")).withColumnRenamed("_kind", "_k")  # two rows
        score = damping * F.coalesce("flow", F.lit(0.0)) + F.col("seed") * (1 - damping * F.coalesce("moved", F.lit(0.0)))
        state = (
            state.join(flow, (F.col("kind") == F.col("_kind")) & (F.col("host") == F.col("b")), "left")
            .join(F.broadcast(moved), F.col("kind") == F.col("_k"), "left")
            .select("kind", "host", "seed", "fan", score.alias("score"), F.abs(score - F.col("score")).alias("change"))
        )
        state, old = written(state, "scores"), previous
        previous, done = state, done + 1
        if old is not None:
            forget(old)
        if rounds is None and max(r["change"] for r in state.groupBy("kind").agg(F.sum("change").alias("change")).collect()) < enough:  # two rows
            break
    return _by_host(state)


def _by_host(state: DataFrame) -> DataFrame:
    one = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return state.groupBy("host").agg(one("trust"), one("distrust"))


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: tuple = RULES,
    damping: float = DAMPING,
    rounds: int | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per page: id, host, path, rule, verdict, trust and distrust of its host.

    Edges are the links with a host in the page's html, ``//host/`` having the page's own
    scheme, from its host to the linked one, whether that has pages or not; links within
    a host are no edges. Seeds are the hosts of whose pages the rules allow, or block,
    more than half; of a host without pages, the links to it count. A null url, or one without
    ``://``, has empty host and path; the empty host is never a seed, and is allowed.
    Null html has no links. Repeated rows and null ids are judged and returned each; an
    empty table gives an empty result; other columns are not read.
    """
    judged = pages.select(F.col(id_col).alias("_page"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"), F.col(html_col).alias("_html"), F.regexp_extract(F.col(url_col), r"(?s)^(.*?)://", 1).alias("_scheme"))
    judged = judged.withColumn("_rule", rule_for(F.col("_host"), F.col("_path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("_rule.verdict") == verdict, 1.0).otherwise(0.0)) > 0.5
    seen = written(
        judged.where("_host <> ''").groupBy("_host").agg(share("allow").alias("_good"), share("block").alias("_bad")), "hosts"
    )
    links = judged.where("_host <> ''").select(F.col("_host").alias("src"), "_scheme", F.explode(F.regexp_extract_all("_html", F.lit(HREF), F.lit(1))).alias("_to"))
    links = links.withColumn("_to", F.when(F.col("_to").startswith("//"), F.concat("_scheme", F.lit(":"), "_to")).otherwise(F.col("_to")))
    links = links.select("src", host_of(F.col("_to")).alias("dst"), path_of(F.col("_to")).alias("_path")).where("dst <> '' AND src <> dst")
    links = links.withColumn("_verdict", rule_for(F.col("dst"), F.col("_path"), rules)["verdict"])
    ruled = lambda verdict: F.sum(F.when(F.col("_verdict") == verdict, 1).otherwise(0))
    edges = written(links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), ruled("allow").alias("_allow"), ruled("block").alias("_block")), "links")
    linked = edges.groupBy("dst").agg(*[(2 * F.sum(c) > F.sum("n")).alias(a) for c, a in (("_allow", "_good"), ("_block", "_bad"))])
    unseen = linked.join(seen, F.col("dst") == F.col("_host"), "left_anti").withColumnRenamed("dst", "_host")
    hosts = written(seen.unionByName(unseen), "all-hosts")
    scores = host_scores(hosts, edges.select("src", "dst", "n"), damping, rounds)
    n = hosts.agg(F.count(F.lit(1)).alias("_n"))  # one row
    scores = scores.crossJoin(F.broadcast(n)).withColumn("_blocked", F.round((F.col("distrust") - F.col("trust")) * F.col("_n"), 9) > threshold)
    scores = written(scores.withColumnRenamed("host", "_host"), "host-scores")
    found = join_spread(written(judged.drop("_html", "_scheme"), "judged"), scores, "_host")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_blocked"), "block").otherwise("allow"))
    return found.select(
        F.col("_page").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
