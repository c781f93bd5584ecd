"""Connected components of a graph of links, by alternating large and small stars.

Each round links every node's neighbours to its least neighbour, first the larger ones, then the
smaller ones. Rounds end when the links no longer change; then every node is linked to the least node
of its component. A round moves each link once or twice, whatever the size of a component. Least
neighbours are written before the join, so Spark can split the rows of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import store


def least(pairs: DataFrame) -> DataFrame:
    return store(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); the component is its least node."""
    edges = store(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 30))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.where("u <> v").distinct(), "large")
        small = large.join(least(large), "u")
        edges = store(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "small",
        )
