"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersum.functions.scratch import drop
from tiersum.llm.common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """edges(a, b long) -> (node, component): one row per node that has a link to another node.

    component is the smallest node reachable. Self-links, null ends, repeated and reversed links change nothing; an
    empty table gives an empty one. Each round is two grouped minima and two joins on the link table, which never
    holds more than one row per link; no link leaves the executors. Raises if max_rounds don't settle it.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links")
    state = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of a node moves to the smallest node around it
        large = links.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("p")).select("p.u", F.col("p.m").alias("v")).filter("u <> v").distinct()
        links, before = materialize(small, "links"), links
        drop(before)
        got = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v"), F.col("v"))).distinct()
        state = tuple(got)
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
