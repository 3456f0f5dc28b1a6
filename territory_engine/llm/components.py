"""Connected components of a link table, as alternating large-star and small-star joins.

Every round is two group-and-join steps on the links. Minimum neighbours are aggregated
map-side and joined back, so a node with very many links is never gathered in one place, and
each round is written to the shared folder so that lost executors repeat one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory_engine.llm.common import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return (both.filter(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    # after the large star every link runs from a larger node a to a smaller node b
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    down = e.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not its component's smallest node.

    Nodes are longs; self links, repeated links and either direction are fine, null ends are
    ignored. Empty links give an empty table. Nodes that are themselves smallest, or that have no
    link, are not listed (their root is the node).
    """
    e = (links.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    e = written(e, f"{name}-links")
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        e = written(_small_star(_large_star(e)), f"{name}-round")
