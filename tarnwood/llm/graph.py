"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes of ``edges(a, b)``.

    Labels fall to the least label among the neighbours, then to the label of
    their label, so chains shorten by half or more with each round. Every round
    is a written table. Null ends are no edges; an empty table gives no rows.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = scratch.keep(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels0")
    step = 0
    while True:
        step += 1
        low = both.join(labels.withColumnsRenamed({"node": "b", "root": "r"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        near = labels.join(low, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = scratch.keep(near.join(up, "root").select("node", "old", F.least("root", "up").alias("root")), f"labels{step}")
        moved = new.where("root <> old").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not moved:
            scratch.drop(both)
            return labels.select("node", "root")
