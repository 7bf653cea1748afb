"""Connected components of an edge table by minimum labels and pointer jumping, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixsieve.llm.common import stored


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (a, b) of any type with an order, any direction.

    Each round takes the smallest label among a node's neighbours, then jumps to that label's own label; rounds end when
    nothing changes. Labels are written to the shared folder after each round. A node with very many edges is a skewed join
    key whose other side is one row, and its minimum is pre-aggregated.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), name)
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("seen"))
        heard = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jumped"))
        following = stored(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("jumped", "label")).alias("label")), name)
        changed = following.where("old <> label").limit(1).count()
        labels = following.select("node", "label")
        if not changed:
            return labels
