"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweft.llm.common import stored


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, component) of every node of the edges (a, b): the least node it can reach.

    Loops, repeated and reversed edges are harmless; nodes without a link to another are left out. Every
    round is two grouped minima joined back to the edges, so no node's neighbours are ever gathered, and is
    written to the shared folder. The number of rounds is logarithmic in the longest path.
    """
    stars = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    state = None
    while (now := _state(stars)) != state:
        state = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        joined = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        stars = stored(joined.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    ends = stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())


def _state(stars: DataFrame) -> tuple:
    mix = F.xxhash64("u", "v")
    r = stars.agg(F.count(F.lit(1)), F.sum(mix.bitwiseAND(F.lit((1 << 31) - 1))), F.sum(F.shiftright(mix, 32)), F.sum(F.xxhash64("v").bitwiseAND(F.lit((1 << 31) - 1)))).first()
    return tuple(r)
