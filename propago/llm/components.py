"""Connected components of a graph whose links are rows: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propago.session import cut


def _pairs(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Each round halves the stars' depth and is cut by a reliable checkpoint; a node's neighbours meet only in sums and
    minima, never in one task's memory. No links give no rows. Raises if ``rounds`` do not suffice.
    """
    edges = cut(_pairs(links))
    state = None
    for _ in range(rounds):
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.filter("m > n").join(low, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        edges = cut(small.select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.countDistinct("u"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state and now[0] == now[1]:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
