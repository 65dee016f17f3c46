"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm.common import store

def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def roots(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``links(u, v)`` that isn't its own root.

    Only counts and checksums reach the driver. Minima are summed up before each shuffle and read back, so that
    the joins that follow are plain equi-joins of two tables, in which adaptive execution splits a hub's rows.
    Each step is stored as a table, whose size Spark then knows (estimates that are carried along would be squared by every
    join). Rounds go on until nothing changes (a path of n nodes takes some log n of them). Null nodes are linked to nothing;
    repeated links count once; an empty table gives an empty result.
    """
    edges = store(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = store(large)
        least = store(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = store(small.filter("u <> v").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
