"""Connected components by minimum labels and pointer jumping, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansmith.llm.common import discard, hot_keys, join_hot, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), of any orderable type, to (node, label): label is the least node that can be reached.

    Only nodes with an edge appear; loops and repeated edges do no harm; no edges, no rows. Every step is a table in
    the shared folder, removed when the next one is there: no lineage grows, and nothing but flags and counts come to the driver.
    Hubs and large components meet their labels where their rows are. Labels at least halve
    their distance to the least node each time, so rounds grow with the logarithm of the longest path.
    """
    pairs = edges.select("u", "v")
    both = stored(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    most = both.count()
    hubs = hot_keys(both, "v", most)
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = join_hot(both, labels.withColumnRenamed("node", "v"), "v", hubs).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        spread = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        ends = spread.select(F.col("node").alias("label"), F.col("label").alias("end"))
        large = hot_keys(spread, "label", most)
        jumped = stored(join_hot(spread, ends, "label", large).select("node", "old", F.least("label", "end").alias("label")), "labels")
        changed = jumped.filter(F.col("old") != F.col("label")).limit(1).count()
        discard(labels, spread, *([large] if large else []))
        labels = jumped.select("node", "label")
        labels._stored_at = jumped._stored_at
        if not changed:
            discard(both, *([hubs] if hubs else []))
            return labels
