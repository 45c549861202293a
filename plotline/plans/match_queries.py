"""Queries over the match of the town's addresses, each with its SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.functions import address as A
from plotline.operators import match as M
from plotline.operators.realign import estimate, run_summary
from plotline.operators.settings import MatchSettings
from plotline.plans import town
from plotline.plans.match_sql import select
from plotline.spread import stored

SETTINGS = MatchSettings(match_distance=4.0)


class Town:
    """The match's steps over the town. Steps that several others read are written once;
    each query makes only those it needs."""

    settings = SETTINGS
    synthetic = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.cells = town.cells(spark, sf_dir)
        self.addresses = town.addresses(spark, sf_dir)
        self.plain_buildings = town.buildings(spark, sf_dir, SETTINGS)
        self.plain_existing = town.existing(spark, sf_dir)

    @cached_property
    def buildings(self) -> DataFrame:
        return stored(A.with_normal(self.plain_buildings, "b_"), "buildings")

    @cached_property
    def existing(self) -> DataFrame:
        return stored(A.with_normal(self.plain_existing, "e_"), "existing")

    @cached_property
    def located(self) -> DataFrame:
        return M.assign_cells(self.addresses, self.cells, self.settings)

    @cached_property
    def groups(self) -> DataFrame:
        return stored(A.with_normal(M.group_addresses(self.located)), "groups")

    @cached_property
    def pairs(self) -> DataFrame:
        return stored(M.building_cells(self.buildings, self.cells, self.groups.where("cell_id IS NOT NULL"), self.settings, parcels=not self.synthetic), "pairs")

    @cached_property
    def ranked(self) -> DataFrame:
        return M.rank_buildings(self.groups, self.pairs, self.buildings, self.settings, self.synthetic)

    @cached_property
    def matches(self) -> DataFrame:
        return M.best_existing(self.groups, M.existing_in_cells(self.existing, self.cells))

    @cached_property
    def proposals(self) -> DataFrame:
        return stored(M.bucket_addresses(self.groups, self.ranked, self.pairs, self.matches, self.settings), "proposals")

    @cached_property
    def final(self) -> DataFrame:
        return M.shared_building_pass(self.proposals, self.groups, self.buildings, self.existing)


def address_in_parcel(spark, sf_dir) -> DataFrame:
    return Town(spark, sf_dir).located.where("cell_id IS NOT NULL AND NOT snapped").select("id", "cell_id")


def snap_to_parcel(spark, sf_dir) -> DataFrame:
    return Town(spark, sf_dir).located.where("snapped").select("id", "cell_id", F.round("cell_distance", 6).alias("distance"))


def exact_key_dedup(spark, sf_dir) -> DataFrame:
    return Town(spark, sf_dir).groups.select("id", F.size("dup_ids").cast("long").alias("dups"), "cell_id")


def cross_cell_duplicates(spark, sf_dir) -> DataFrame:
    return Town(spark, sf_dir).groups.where("cross_dup").select("id", "exact")


def building_cell_overlap(spark, sf_dir) -> DataFrame:
    return Town(spark, sf_dir).pairs.select("bid", "cell_id", "area_in", F.round("share", 6).alias("share"), F.round("cell_score", 6).alias("score"))


def home_parcel(spark, sf_dir) -> DataFrame:
    pairs = Town(spark, sf_dir).pairs
    return pairs.groupBy("bid").agg(F.count(F.lit(1)).alias("cells"), F.max(F.round("share", 6)).alias("most"))


def rank_buildings(spark, sf_dir) -> DataFrame:
    return Town(spark, sf_dir).ranked.select("id", "bid", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "extra")


def runner_up_ratio(spark, sf_dir) -> DataFrame:
    return Town(spark, sf_dir).ranked.where("rank = 1").select("id", "bid", F.round("ratio", 6).alias("ratio"))


def compare_existing(spark, sf_dir) -> DataFrame:
    return Town(spark, sf_dir).matches.select("id", "existing_kind", "n_existing")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "bucket", F.round("confidence", 6).alias("confidence"), "target", "kind")


def bucket_rules(spark, sf_dir) -> DataFrame:
    return _shown(Town(spark, sf_dir).proposals)


def bucket_assign(spark, sf_dir) -> DataFrame:
    final = Town(spark, sf_dir).final
    return final.select("id", "bucket", F.round("confidence", 6).alias("confidence"), "target", "kind", "keeps_node")


def bucket_counts(spark, sf_dir) -> DataFrame:
    return Town(spark, sf_dir).final.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def shared_building_pass(spark, sf_dir) -> DataFrame:
    return Town(spark, sf_dir).final.where("keeps_node").select("id", "bucket", "target")


def unit_groups(spark, sf_dir) -> DataFrame:
    t = Town(spark, sf_dir)
    rows = t.proposals.where("target IS NOT NULL").join(t.groups.select(F.col("id").alias("_g"), "number", "street", "unit"), F.col("id") == F.col("_g"))
    rows = rows.where(~A.blank(F.col("unit")))
    return rows.groupBy(A.address_key(F.col("number"), F.col("street")).alias("address")).agg(F.count_distinct("target").alias("buildings"))


def split_by_parcel(spark, sf_dir) -> DataFrame:
    """Buildings with an address of which less than the tolerance allows lies in its cell."""
    t = Town(spark, sf_dir)
    rows = t.proposals.where("target IS NOT NULL AND kind IS NULL").join(t.groups.select(F.col("id").alias("_g"), "cell_id"), F.col("id") == F.col("_g"))
    shares = t.pairs.select(F.col("bid").alias("_b"), F.col("cell_id").alias("_c"), "share")
    rows = rows.join(shares, (F.col("target") == F.col("_b")) & (F.col("cell_id") == F.col("_c")), "left")
    return rows.groupBy("target").agg(F.round(F.min(F.coalesce("share", F.lit(0.0))), 6).alias("least")).where(F.col("least") < 0.8)


def address_shift(spark, sf_dir) -> DataFrame:
    """Median offset from point to building centre over clean single matches, and its spread."""
    t = Town(spark, sf_dir)
    rows = t.proposals.where("bucket = 'CLEAN' AND target IS NOT NULL").join(t.groups.select(F.col("id").alias("_g"), "x", "y"), F.col("id") == F.col("_g"))
    rows = rows.join(t.buildings, F.col("target") == F.col("bid"))
    return estimate(rows.select(((F.col("bxmin") + F.col("bxmax")) / 2 - F.col("x")).alias("dx"), ((F.col("bymin") + F.col("bymax")) / 2 - F.col("y")).alias("dy")))


def analysis_summary(spark, sf_dir) -> DataFrame:
    t = Town(spark, sf_dir)
    return run_summary(t.addresses, t.groups, t.cells, t.final)


QUERIES = {
    f.__name__: f
    for f in (
        address_in_parcel, snap_to_parcel, exact_key_dedup, cross_cell_duplicates, building_cell_overlap, home_parcel, rank_buildings, runner_up_ratio,
        compare_existing, bucket_rules, bucket_assign, bucket_counts, shared_building_pass, unit_groups, split_by_parcel, address_shift, analysis_summary,
    )
}

_SHOWN = "id, bucket, round(confidence, 6) AS confidence, target, kind"
SQL = {
    "address_in_parcel": select("id, cell_id", "located WHERE cell_id IS NOT NULL AND NOT snapped"),
    "snap_to_parcel": select("id, cell_id, round(cell_distance, 6) AS distance", "located WHERE snapped"),
    "exact_key_dedup": select("id, dups, cell_id", "groups"),
    "cross_cell_duplicates": select("id, exact", "groups WHERE cross_dup"),
    "building_cell_overlap": select("bid, cell_id, area_in, round(share, 6) AS share, round(cell_score, 6) AS score", "pairs"),
    "home_parcel": select("bid, count(*) AS cells, max(round(share, 6)) AS most", "pairs GROUP BY bid"),
    "rank_buildings": select("id, bid, rank, round(score, 6) AS score, extra", "ranked"),
    "runner_up_ratio": select("id, bid, round(ratio, 6) AS ratio", "ranked WHERE rank = 1"),
    "compare_existing": select("id, ek AS existing_kind, ne AS n_existing", "bestx"),
    "bucket_rules": select(_SHOWN, "proposals"),
    "bucket_assign": select(_SHOWN + ", keeps_node", "final"),
    "bucket_counts": select("bucket, count(*) AS n, round(avg(confidence), 6) AS mean_confidence", "final GROUP BY bucket"),
    "shared_building_pass": select("id, bucket, target", "final WHERE keeps_node"),
    "analysis_summary": select(
        "(SELECT count(*) FROM addresses) AS addresses, (SELECT sum(dups) FROM groups)::BIGINT AS duplicates, (SELECT count(*) FROM cells) AS cells, "
        "(SELECT count(DISTINCT CASE WHEN kind IS NULL AND target IS NOT NULL THEN 'b' || target ELSE 'n' || id END) FROM final) AS proposals",
        "n",
    ),
    "unit_groups": select("plain AS address, count(DISTINCT target) AS buildings", "pr1 WHERE hu AND target IS NOT NULL GROUP BY plain"),
    "split_by_parcel": select(
        "target, round(min(share), 6) AS least",
        "(SELECT p.target, coalesce(q.share, 0) AS share FROM proposals p JOIN groups g USING (id) LEFT JOIN pairs q ON q.bid = p.target AND q.cell_id = g.cell_id "
        "WHERE p.target IS NOT NULL AND p.kind IS NULL) GROUP BY target HAVING round(min(share), 6) < 0.8",
    ),
    "address_shift": select(
        "round(any_value(mx), 6) AS dx, round(any_value(my), 6) AS dy, round(median(sqrt((dx - mx) ** 2 + (dy - my) ** 2)), 6) AS spread, count(*) AS samples, "
        "count(*) >= 20 AND sqrt(any_value(mx) ** 2 + any_value(my) ** 2) >= 5 AND median(sqrt((dx - mx) ** 2 + (dy - my) ** 2)) < 0.5 * sqrt(any_value(mx) ** 2 + any_value(my) ** 2) AS significant",
        "(SELECT dx, dy, median(dx) OVER () AS mx, median(dy) OVER () AS my FROM (SELECT (bxmin + bxmax) / 2 - x AS dx, (bymin + bymax) / 2 - y AS dy "
        "FROM proposals JOIN groups USING (id) JOIN buildings ON bid = target WHERE bucket = 'CLEAN')) HAVING count(*) >= 5",
    ),
}
