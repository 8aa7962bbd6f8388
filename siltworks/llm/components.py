"""Connected components of links, by alternating large and small stars.

Each round is two joins of the links with the least neighbour of each node, and its result is written
to the shared folder, so no plan grows with the rounds and nothing is gathered on the driver but one
sum a round. The number of rounds grows with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b): each node of `links` (a, b) but the least of its component, with that least node."""
    links = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        links = stored(_small_star(_large_star(links)), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links
        before = now
    raise RuntimeError(f"components are not stable after {max_rounds} rounds")
