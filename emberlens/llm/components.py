"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges(a, b)``: each node's component by its
    smallest node.

    Each round replaces a node's links by links to the smallest of its neighbours,
    first for the larger neighbours, then for the smaller ones, until nothing changes;
    the number of rounds grows with the logarithm of the longest path. Sums are made
    before rows are shuffled, and a node with very many links meets them in a join
    whose partitions Spark may split. Each round is checkpointed.
    """
    links = _ordered(edges.select("a", "b")).checkpoint()
    before = None
    for _ in range(most_rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        links = _small_star(_large_star(links)).checkpoint()
    else:
        raise RuntimeError(f"components are still changing after {most_rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger node to the smaller."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of it and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("hub")).agg(F.min(F.least("a", "b")).alias("m"))
    larger = links.select(F.col("b").alias("hub"), F.col("a").alias("leaf"))
    return _ordered(larger.join(least, "hub").select(F.col("leaf").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = links.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("m"))
    moved = links.select(F.col("a").alias("hub"), F.col("b").alias("leaf")).join(least, "hub").select(F.col("leaf").alias("a"), F.col("m").alias("b"))
    return _ordered(moved.unionByName(least.select(F.col("hub").alias("a"), F.col("m").alias("b"))))
