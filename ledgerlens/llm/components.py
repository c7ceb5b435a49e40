"""Connected components of a distributed edge list by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, root) for every node with an edge; the root is the
    component's smallest node.

    Each turn every node takes its smallest neighbour as parent, parents are
    followed one step further, and edges between the parents go on. Turns are
    written to the shared folder, their number grows with the logarithm of the
    longest chain; hubs only meet partial minima and splittable joins. Nulls and
    loops are ignored; an empty list gives an empty result.
    """
    pair = edges.where("a <> b").select("a", "b").distinct()
    left = written(pair, "cc-edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
    labels = written(nodes.withColumn("root", F.col("node")), "cc-labels")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parent = written(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("up")), "cc-parents")
        jump = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = written(parent.join(jump, "up").select("node", "top"), "cc-jumps")
        labels = written(labels.join(parent.withColumnRenamed("node", "root"), "root", "left").select(
            "node", F.coalesce("top", "root").alias("root")), "cc-labels")
        pa, pb = parent.toDF("a", "ta"), parent.toDF("b", "tb")
        left = written(left.join(pa, "a").join(pb, "b").where("ta <> tb").select(
            F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-edges")
    return labels
