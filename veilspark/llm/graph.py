"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or not larger) neighbours of every node on its smallest neighbour.

    Minima are aggregated before the shuffle and joined back, so a node with very
    many links is never gathered.
    """
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    else:  # links point from the larger to the smaller node
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.toDF("a", "b"))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each end of ``links(a, b)``; a component's id is its smallest node.

    Large-star and small-star steps alternate until nothing changes; each pair of steps is
    written to the shared folder, which cuts the lineage.  Null ends and loops are left out.
    """
    links = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        links = stage(_star(_star(links, True), False), "links")
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(links.select("b", "b").distinct())
