"""Connected components of a table of links, by large and small stars in turn (Kiveris et al., 2014).

A star moves every link of a node to the smallest node around it; after a few rounds each node is linked to the smallest of
its component alone. The smallest neighbour is a partial minimum and is joined back as a table, so a node with very many links
costs each task one row. Every round goes to a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

MOST_ROUNDS = 60


def star(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b. The same components with links a > b nearer to the smallest node."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = cut(least, "least")
    moved = both.where("b > a") if large else both
    out = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: two columns of nodes (long). node, root: the smallest node of its component; nodes that have links only."""
    a, b = links.columns
    now = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = cut(star(cut(star(now, True), "large"), False), "small")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
