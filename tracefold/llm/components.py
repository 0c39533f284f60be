"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import Scratch


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for each end of the edges (a, b): the smallest node that can be reached.

    In each round a node points to its least neighbour, if that is less than itself, and then to where that one
    points. Edges are contracted along the pointers, and what is left of them, without repetitions, is the next
    round's graph; rounds end when nothing is left. A star of any size is gone after one round. A node with very many
    neighbours is only ever a key of joins, whose partitions can be split, and of minima, which are taken before the
    shuffle.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = scratch.table(edges.select(*pair).filter("a < b").distinct(), f"{name}-edges")
    total, turn = None, 0
    while total is None or left.limit(1).count():
        turn += 1
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")), f"{name}-{turn}-point")
        far = point.select(F.col("node").alias("_node"), F.col("to").alias("label"))
        jump = scratch.table(point.join(far, point["to"] == far["_node"]).select("node", "label"), f"{name}-{turn}-jump")
        ends = left.join(jump.select(F.col("node").alias("a"), F.col("label").alias("_a")), "a").join(jump.select(F.col("node").alias("b"), F.col("label").alias("_b")), "b")
        # where a pointer's end points on, that link must stay too
        ended = jump.filter("node <> label").join(jump.select(F.col("label").alias("node")).distinct(), "node", "left_semi")
        next_ = ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")).union(ended.select("node", "label"))
        if total is None:
            total = jump
        else:
            onward = jump.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
            total = total.join(onward, total["label"] == onward["_node"], "left").select("node", F.coalesce("_label", "label").alias("label"))
            total = scratch.table(total, f"{name}-{turn}-total")
        left = scratch.table(next_.select(*pair).filter("a < b").distinct(), f"{name}-{turn}-edges")
    return total
