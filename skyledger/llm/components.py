"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import durable, tidy


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over undirected ``a, b`` with a > b: each node's neighbours move to the least of them.

    A node's least neighbour comes from a grouping that is merged before the shuffle, and goes back
    by an equi-join, which Spark splits where a node has very many neighbours.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    seen = both.join(least, "a")
    if large:  # neighbours above the node itself
        out = seen.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:  # neighbours below it, and the node
        out = seen.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


@tidy
def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node with an edge; the root is the component's least node.

    The number of rounds grows with the logarithm of the size; the loop ends when the edges no longer
    change, which is when each node hangs on its root.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    for _ in range(most_rounds):
        edges = durable(star(star(edges, large=True), large=False))
        now = mark(edges)
        if now == seen:
            leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
