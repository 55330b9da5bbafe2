"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node in ``links`` (a, b); each round is a written table.

    Labels spread along links, then jump to the label of their label, so long chains shorten by powers.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = runtime.written(both, "links")
    labels = runtime.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = labels.join(jump, "component", "left").join(near, "node").select("node", F.least("component", "far", "near").alias("component"), F.col("component").alias("old"))
        new = runtime.written(new, "labels")
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
