"""Connected components of links too many for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for each node of a link, the smallest node that links lead to. Null ends and loops don't count.

    Alternates two steps on the links until they no longer change: every larger neighbour of a node is linked to
    the smallest node around it (large star), then every smaller one and the node itself (small star). Each
    step is a join on the node, whose hot keys AQE splits, and the links never grow beyond their first number.
    """
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    mark, old = None, None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = saved(small, "links")
        if old is not None:
            drop_saved(old)
        old = links
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = now
