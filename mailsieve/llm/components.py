"""Connected components of a graph given by its links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.operators.durable import durable


def _settled(edges: DataFrame) -> bool:
    """Does every edge lead to the least node of its component: one edge a node, and none to a node with one?"""
    inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return inner.isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its least node.

    Alternating star contractions: every round ties the larger neighbours of a node to the least one, then
    the smaller ones, until all edges are stars; the rounds grow with the logarithm of the longest
    chain. Each round is written, so nothing is redone after a loss. A node with very many links costs one
    combined row per task in the aggregations, and the joins meet it in splittable pieces. Links with a
    null end, loops and repeated links are ignored; no links give no rows.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = durable(links.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "links")
    while not _settled(edges):
        # Large star: b is smaller than a; each node's least neighbour or itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        up = durable(up, "large-star")
        # Small star: each node's smaller neighbours and the node itself go to the least of them.
        least = durable(up.groupBy("a").agg(F.min("b").alias("m")), "least")
        down = up.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(down.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
