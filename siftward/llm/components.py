"""Connected components of a graph of links, by rounds of joins whose results are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftward.llm.common import cut_lineage, met


def stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step. Links are (a, b) with a > b; so are those returned.

    Large: every larger neighbour of a node is linked to the node's smallest neighbour.
    Small: every smaller neighbour, and the node itself.
    Both sides of the join are exchanged, so a node with very many links can be split.
    """
    if large:
        near = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    least = cut_lineage(least.select("a", F.least("a", "m").alias("m")))
    joined = met(near, least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("a <> m"))
    return cut_lineage(out.where("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for each node with a link.

    ``links`` has two columns of one type; their order, repeats and links of a node to itself do not matter.
    A number of rounds near the logarithm of the longest chain suffices; only a count and a sum of hashes come
    to the driver.
    """
    left, right = links.columns[:2]
    pairs = links.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("a"), F.least(left, right).alias("b")
    )
    now = cut_lineage(pairs.distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        if not state.n or state == before:
            break
        before = state
        now = stars(stars(now, large=True), large=False)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
