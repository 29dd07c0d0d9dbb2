"""Connected components of a link table, by alternating star contractions.

Each round points a node's larger neighbours at its smallest neighbour (large star), then its smaller ones and itself at their
smallest (small star), until nothing changes: every component is then a star around its smallest node. Rounds grow with
the logarithm of a component's size, not with its diameter. Each half round is written to the shared folder, so
lineage stays short, and its join is between written tables, whose hot keys Spark may split. Links and labels stay on the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def star_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the component's smallest node. Links may repeat, and may be given either way round."""
    edges = stash(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
        large = stash(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stash(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
