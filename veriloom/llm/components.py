"""Connected components by least labels with pointer jumping, on DataFrames.

Each round takes the least label among a node's neighbours and then the label of that label,
until nothing changes; rounds are few because labels jump. Every round is cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import checkpointed, compact


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of the nodes that occur in links (a, b: long)."""
    both = compact(checkpointed(links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()))
    labels = compact(checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", F.least("component", "m").alias("next"), F.col("component").alias("before"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        after = compact(checkpointed(lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("component"), "before")))
        changed = after.where("component <> before").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
