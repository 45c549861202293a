"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.session import forget, written


def components(edges: DataFrame) -> DataFrame:
    """Rows (_node, _root) for every node with an edge (_a, _b), _root the smallest node
    connected.

    Each round a node takes the least label of its neighbours and itself, then the label
    of that label. Rounds end when no label changes; each is written, as lineage would
    grow otherwise.
    """
    both = written(edges.select("_a", "_b").unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("_a").alias("_node")).agg(F.least(F.min("_b"), F.col("_a")).alias("_root")), "labels")
    while True:
        near = both.join(labels, F.col("_b") == F.col("_node")).groupBy("_a").agg(F.min("_root").alias("_near"))
        stepped = labels.join(near, F.col("_node") == F.col("_a")).select("_node", F.least("_root", "_near").alias("_next"), F.col("_root").alias("_was"))
        up = labels.select(F.col("_node").alias("_n"), F.col("_root").alias("_up"))
        jumped = stepped.join(up, F.col("_next") == F.col("_n")).select("_node", F.least("_next", "_up").alias("_root"), "_was")
        after = written(jumped, "labels")
        changed = bool(after.where("_root <> _was").take(1))
        forget(labels)
        labels = after
        if not changed:
            return labels.select("_node", "_root")
