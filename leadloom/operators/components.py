"""Connected components of the leads that keys hold together, in rounds that grow with the logarithm of a component's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stash


def key_components(posts: DataFrame, keys: tuple[str, ...] = ("kind", "key")) -> DataFrame:
    """id and root, the smallest id of its component, of every id in posts (id, keys): ids that share a key belong together.

    A key's ids hang on its smallest one, so a hot key is as many links as it has ids. Then, in turn, what hangs on an id is hung on the smallest id known
    to it, from above and from below, until every id hangs on its root; each half round is written."""
    least = posts.groupBy(*keys).agg(F.min("id").alias("low"))
    ids = stash(posts.select("id").distinct(), "component-ids")
    links = stash(posts.join(least, list(keys)).select(F.col("id").alias("high"), "low").where("high <> low").distinct(), "component-links")
    seen = None
    while (now := tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())) != seen and now[0]:
        seen = now
        both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
        near = stash(both.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("root")), "component-roots")
        above = stash(both.join(near, "high").where("low > high").select(F.col("low").alias("high"), F.col("root").alias("low")).where("high <> low").distinct(), "component-links")
        near = stash(above.groupBy("high").agg(F.min("low").alias("root")), "component-roots")
        below = above.join(near, "high").where("low <> root").select(F.col("low").alias("high"), F.col("root").alias("low"))
        links = stash(below.unionByName(near.select("high", F.col("root").alias("low"))).distinct(), "component-links")
    roots = links.groupBy(F.col("high").alias("id")).agg(F.min("low").alias("root"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
