"""Connected components of a link table by alternating large-star and small-star steps.

Every step is an aggregation and a join; nothing is gathered on the driver but one count and one checksum a
round. Each round's links go to the shared checkpoint folder, so the plan does not grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import checkpoint


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on its smallest neighbour (or itself)."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # its own checkpoint lets the join deal both sides itself: AQE then splits the rows of a node with many links
    least = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return checkpoint(out.where(F.col("a") != F.col("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links(a, b)``; root is the smallest node reachable. Links are undirected; loops and repeats do no harm."""
    sign = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    links = checkpoint(links.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    before = sign(links)
    while before[0]:
        links = _star(_star(links, large=True), large=False)
        after = sign(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
