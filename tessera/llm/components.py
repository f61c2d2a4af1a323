"""Connected components of a graph of links, in joins and aggregations.

Alternating large-star and small-star steps: every node hangs its larger neighbours, then itself and its smaller
neighbours, on the smallest node next to it, until nothing changes; the number of steps grows with the logarithm of the
longest chain. Each step is written to the shared folder, so a lost executor repeats one step at most. A node with many
neighbours is pre-aggregated before the shuffle, and joins read written tables on both sides, so that Spark can split a
hot node's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MAX_STEPS = 60


def _star(links: DataFrame) -> DataFrame:
    """links(u, v) with v < u to the same kind of links, nearer to the smallest node of each component."""
    both = links.union(links.select("v", "u")).toDF("u", "v")
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
    larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = materialise(larger.filter("u != v").distinct(), "star-large")
    least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    joined = large.join(least, "u")
    small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return materialise(small.filter("u != v").distinct(), "star-small")


def components(links: DataFrame) -> DataFrame:
    """links(u, v) in either direction to (u, root): the smallest node of each component, for all its other nodes."""
    links = materialise(
        links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = None
    for _ in range(MAX_STEPS):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select("u", F.col("v").alias("root"))
        before, links = now, _star(links)
    raise RuntimeError(f"components are not settled after {MAX_STEPS} steps")
