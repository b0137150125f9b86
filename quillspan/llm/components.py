"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link to another.

    Self-links, repeated links and nulls are ignored. Each round's links are written to the shared folder; rounds grow
    with the logarithm of the longest chain, and no more than a checksum reaches the driver.
    """
    e = edges.select(F.col(u).cast("long").alias("a"), F.col(v).cast("long").alias("b")).where("a <> b")
    e = written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        nxt = written(small.distinct(), "small-star")
        now = _state(nxt)
        dropped(large)
        dropped(e)
        e = nxt
        if now == seen:
            break
        seen = now
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
