"""Checks along chains of roads. Every road of the town is four ways, every third of them
drawn backwards, and the town is turned by a 3-4-5 triangle, so that no road is level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.operators import chains as C
from plotline.operators import sequence as Q
from plotline.plans import quality_queries
from plotline.plans.polygon_queries import SCALE, turned
from plotline.spread import stored

PIECES = 4


def _turned(x, y):
    tx, ty = turned(x, y)
    return tx / SCALE, ty / SCALE


def _roads(spark, sf_dir, place=_turned) -> DataFrame:
    """Ways (key, way, nodes, xs, ys, service) of the roads."""
    roads = quality_queries._roads(spark, sf_dir)
    r, j = F.col("road_id"), F.col("j")
    x = lambda k: F.col("ax") + (F.col("bx") - F.col("ax")) * k / PIECES
    ways = roads.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    (xa, ya), (xb, yb) = place(x(j), F.col("ay")), place(x(j + 1), F.col("ay"))
    back = (r * PIECES + j) % 3 == 0
    pair = lambda a, b: F.when(back, F.array(b, a)).otherwise(F.array(a, b))
    return ways.select("key", (r * PIECES + j).alias("way"), pair(r * 10 + j, r * 10 + j + 1).alias("nodes"), pair(xa, xb).alias("xs"), pair(ya, yb).alias("ys"), F.lit(None).cast("string").alias("service"))


def _addresses(spark, sf_dir) -> DataFrame:
    x, y = _turned(F.col("x"), F.col("y"))
    return quality_queries._addresses(spark, sf_dir).withColumns({"x": x, "y": y})


def _placed(spark, sf_dir) -> DataFrame:
    roads = stored(_roads(spark, sf_dir), "roads")
    found = C.dead_ends(stored(C.road_chains(roads), "chains"), roads)
    return C.placed_on_chains(_addresses(spark, sf_dir), stored(C.chain_pieces(found), "pieces"))


def road_chains(spark, sf_dir) -> DataFrame:
    """Each chain's first way, number of ways and length, and whether its ends are dead."""
    roads = stored(_roads(spark, sf_dir), "roads")
    found = C.dead_ends(stored(C.road_chains(roads), "chains"), roads)
    pieces = C.chain_pieces(found)
    length = F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    lengths = pieces.groupBy("chain").agg(F.round(F.sum(length), 6).alias("metres"))
    return found.join(lengths, "chain").select("chain", F.size("ways").cast("long").alias("ways"), "metres", "dead_start", "dead_end")


def chain_places(spark, sf_dir) -> DataFrame:
    """Where addresses lie along their chains, from the nearer end."""
    p = _placed(spark, sf_dir)
    return p.select("id", F.floor(F.col("chain") / PIECES).alias("road_id"), F.round(F.least("at", 800 - F.col("at")), 6).alias("metres"), "house", "head", "loop")


def chain_sequence(spark, sf_dir) -> DataFrame:
    rows = Q.out_of_sequence(_placed(spark, sf_dir))
    return rows.select("id", F.floor(F.col("chain") / PIECES).alias("road_id"), "house", F.least("before", "after").alias("lower"), F.greatest("before", "after").alias("upper"))


def chain_parity(spark, sf_dir) -> DataFrame:
    """Only addresses that were visited are reported."""
    visited = _addresses(spark, sf_dir).where("id > 5").select("id")
    rows = Q.wrong_parity(_placed(spark, sf_dir), visited)
    return rows.select("id", F.floor(F.col("chain") / PIECES).alias("road_id"), "house")


QUERIES = {f.__name__: f for f in (road_chains, chain_places, chain_sequence, chain_parity)}

_CTES = quality_queries._BASE + """, oth AS (SELECT id, min(distance) AS d FROM near WHERE key <> ns GROUP BY id),
cp0 AS (SELECT pl.*, greatest(-m, m - 800, 0) > round(sqrt(greatest(distance ** 2 - greatest(-m, m - 800, 0) ** 2, 0)), 9) AS head FROM pl LEFT JOIN oth USING (id) WHERE NOT coalesce(oth.d <= 0.4 * distance, false)),
hd1 AS (SELECT *, count(*) FILTER (NOT head) OVER s AS oc, count(*) FILTER (NOT head AND house % 2 = 0) OVER s AS ec FROM cp0 WINDOW s AS (PARTITION BY road_id, side)),
cp AS (SELECT * FROM hd1 WHERE NOT (head AND oc > 0 AND CASE WHEN house % 2 = 0 THEN oc - ec ELSE ec END >= 0.8 * oc)),
cq AS (SELECT *, lag(house) OVER o AS h0, lead(house) OVER o AS h1, lag(m) OVER o AS m0, lead(m) OVER o AS m1, count(*) OVER (PARTITION BY road_id, side) AS n FROM cp WINDOW o AS (PARTITION BY road_id, side ORDER BY m, id)),
cd AS (SELECT *, sum(sign(house - h0)) OVER (PARTITION BY road_id) AS net, sum(sign(house - h0)) OVER (PARTITION BY road_id, side) AS own FROM cq),
ce AS (SELECT *, CASE WHEN net <> 0 THEN sign(net) ELSE sign(own) END AS dir FROM cd)
"""
SQL = {
    "road_chains": quality_queries._BASE + "SELECT road_id * 4 AS chain, 4::BIGINT AS ways, 800.0::DOUBLE AS metres, true AS dead_start, true AS dead_end FROM roads",
    "chain_places": _CTES + "SELECT id, road_id, round(least(m, 800 - m), 6) AS metres, house, head, false AS loop FROM cp0",
    "chain_sequence": _CTES + """SELECT id, road_id, house, least(h0, h1) AS lower, greatest(h0, h1) AS upper FROM ce WHERE n >= 3 AND dir <> 0 AND dir * h0 < dir * h1
  AND ((dir * house < dir * h0 AND m - m0 >= 8) OR (dir * house > dir * h1 AND m1 - m >= 8))""",
    "chain_parity": _CTES + """SELECT id, road_id, house FROM (SELECT *, count(*) OVER s AS k, count(*) FILTER (house % 2 = 0) OVER s AS e FROM cp WINDOW s AS (PARTITION BY road_id, side))
  WHERE id > 5 AND k >= 4 AND house % 2 <> CASE WHEN e >= 0.8 * k THEN 0 WHEN k - e >= 0.8 * k THEN 1 END""",
}
