"""Connected components by alternating large-star and small-star steps over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One step. links: u, v with u > v, distinct. Each node's neighbours are hung on the smallest among them and itself;
    in a small step only neighbours below the node count (and the node itself is hung on it), in a large step only those
    above it are hung. The minimum is a partial aggregate; the join back is an equi join whose hot side can be split."""
    if small:
        lowest = links.groupBy("u").agg(F.min("v").alias("m"))
        hung = links.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = hung.union(lowest.select("u", F.col("m").alias("v")))
    else:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: each node of `links` (u, v, any order, self links and repeats allowed) and the smallest node it reaches.

    The number of rounds grows with the logarithm of the size of a component. Each round is written to the shared folder."""
    now = settle(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        now = settle(_star(settle(_star(now, small=False)), small=True))
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        mark = sign
