"""Connected components by contraction: every round, each vertex joins the smallest neighbour of its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandwise.session import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``edges`` (a, b); ``root`` is one node of its component.

    Edges are relabelled by where their ends point until none is left; a contraction never parts what is
    connected. Nodes are named by hashes, so long chains of falling names, which would take a round per
    few nodes, do not occur and the number of rounds grows with the logarithm of the nodes. Stars and
    repeated edges are summed up before they are shuffled.
    """
    edges = stage(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        far = near.select(F.col("a").alias("p"), F.col("p").alias("q"))
        up = stage(near.join(far, "p").select("a", F.col("q").alias("p")), "cc-parents")
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            higher = up.select(F.col("a").alias("root"), "p")
            labels = labels.join(higher, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        ends = edges.join(up.select("a", F.col("p").alias("x")), "a").join(up.select(F.col("a").alias("b"), F.col("p").alias("y")), "b")
        edges = stage(
            ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges"
        )
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else stage(labels, "cc-labels")
