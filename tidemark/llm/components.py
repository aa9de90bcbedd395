"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._runtime import stored


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Per node of any edge: node, label (the least node that it reaches). Edges may repeat and may be loops.

    Each round gives a node the least label among its neighbours, then the label of its label, so
    the number of rounds follows the logarithm of the longest path in practice. Every round is
    written to the shared folder; nothing but whether it changed a label comes to the driver.
    """
    a, b = edges.select(F.col(u).alias("node"), F.col(v).alias("other")), edges.select(F.col(v).alias("node"), F.col(u).alias("other"))
    both = stored(a.unionByName(b).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("least"))
        step = stored(labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "least").alias("label")), "labels")
        if step.where("label <> before").isEmpty():
            return step.select("node", "label")
        jump = step.select(F.col("node").alias("at"), F.col("label").alias("next"))
        labels = stored(step.join(jump, F.col("label") == F.col("at"), "left").select("node", F.least("label", "next").alias("label")), "labels")
