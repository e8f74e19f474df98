"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crivo.operators.relational import join_groups
from crivo.session import materialise


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, component): the smallest node each node of `edges` (a, b) can reach. Nodes without an edge do not appear.

    Alternates two steps until the edges stop changing: every node hands its larger neighbours to its smallest
    neighbour, then its smaller ones. Both need only a minimum per node, which folds in each task, and a join; the rounds
    grow with the logarithm of the longest path. Each round is a written table, so a lost executor repeats one round.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, name)
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"), F.count_if(F.col("b") > F.col("a")).alias("larger"))
        least = least.where("larger > 0").select("a", F.least("a", "least").alias("least"), "larger")
        large = join_groups(both.where("b > a"), least, "a", "larger", "b")  # a node may have most edges
        large = large.select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
