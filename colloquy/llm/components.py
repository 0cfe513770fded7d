"""Connected components by alternating large-star and small-star, on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.scratch import Scratch


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = _both(links)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v): every linked node but the least of its component, and that least node.

    ``links`` has columns u, v of one orderable type. Each round is written to the shared folder, where the last
    one stays; rounds grow with the logarithm of the largest component.
    """
    spark = links.sparkSession
    done = Scratch(spark)
    links = done.keep(links.where("u <> v").select("u", "v").distinct(), "links")
    mark = None
    while True:
        now = Scratch(spark)
        links = now.keep(small_star(large_star(links)), "stars")
        done.clear()
        done = now
        # Links and their sum of hashes: a fixed point has every node linked to a root alone.
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            return links
        mark = state
