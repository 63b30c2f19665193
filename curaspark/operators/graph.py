"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.session import cut_lineage, release


def components(edges: DataFrame, keys: Sequence[str] = (), max_rounds: int = 100) -> DataFrame:
    """(keys, node, component) for every node of (keys, a, b); the component is named by its smallest node.

    Each round every node takes the smallest label around it, then the label of its label, so chains shrink fast. A
    round reads the table of the one before and replaces it, and the loop ends when a round changes nothing.
    """
    keys = list(keys)
    both = edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("other"))
    both = cut_lineage(both.unionByName(both.select(*keys, F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    before = labels = cut_lineage(both.groupBy(*keys, "node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    for _ in range(max_rounds):
        around = both.join(labels.select(*keys, F.col("node").alias("other"), "label"), [*keys, "other"])
        nearest = around.groupBy(*keys, "node").agg(F.min("label").alias("near"))
        new = labels.join(nearest, [*keys, "node"]).select(*keys, "node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(*keys, F.col("node").alias("new"), F.col("label").alias("jump"))
        new = new.join(jump, [*keys, "new"], "left").select(
            *keys, "node", F.least("new", F.coalesce("jump", "new")).alias("label"), (F.least("new", F.coalesce("jump", "new")) != F.col("label")).alias("changed")
        )
        new = cut_lineage(new)
        release(before)
        before, labels = new, new.select(*keys, "node", "label")
        if new.filter("changed").isEmpty():
            release(both)
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
