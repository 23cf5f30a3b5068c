"""Connected components of an edge table, by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """a, b (a table from written()) -> node, comp: the least node of each node's component. A label halves its way to the root in every round, so that rounds grow with the logarithm of the longest path."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("least"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        root = hooked.select(F.col("node").alias("r"), F.col("comp").alias("root"))
        jumped = written(hooked.join(root, hooked["comp"] == root["r"]).select("node", "was", F.least("comp", "root").alias("comp")), "labels", edges)
        labels = jumped.select("node", "comp")
        if jumped.filter("comp <> was").isEmpty():
            return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, comp; a table from written()) after edges (a, b) between nodes join their components. Every node of edges must be in labels."""
    left = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    right = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    between = written(edges.join(left, "a").join(right, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct(), "between", labels)
    if between.isEmpty():
        return labels
    roots = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    return written(labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "merged", labels)
