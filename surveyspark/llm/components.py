"""Connected components as Spark joins, written to the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that each node's component reaches.

    Each round every node hooks to its smallest neighbour, takes that neighbour's hook, and edges
    move to the hooks; edges inside a hook vanish. Minima are aggregated before the shuffle, so a
    node with many neighbours costs one row per task. Node numbers should be hashes: then the
    rounds grow with the logarithm of the components' size. Self-loops only name their node.
    """
    edges = staged(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct(), "cc-edges")
    labels = None
    while True:
        both = edges.union(edges.select("v", "u"))
        hooks = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        hooks = staged(hooks, "cc-hooks")
        jump = hooks.select(F.col("u").alias("p"), F.col("p").alias("q"))
        hooks = staged(hooks.join(jump, "p").select("u", F.col("q").alias("p")), "cc-jump")
        if labels is None:
            labels = hooks.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            moved = hooks.select(F.col("u").alias("label"), "p")
            labels = staged(labels.join(moved, "label", "left")
                            .select("node", F.coalesce("p", "label").alias("label")), "cc-labels")
        ends = hooks.select("u", F.col("p").alias("pu")), hooks.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = staged(edges.join(ends[0], "u").join(ends[1], "v").filter(F.col("pu") != F.col("pv"))
                       .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "cc-edges")
        if edges.isEmpty():
            return labels
