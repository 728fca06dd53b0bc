"""Connected components by alternating large-star and small-star steps, each written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.base import BROADCAST_ROWS
from weir.session import Scratch, counts


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of an edge (u, v); comp is the smallest node reachable. No edges: no rows."""
    mark = F.sum(F.xxhash64("u", "v") % 1_000_003).alias("mark")
    at = scratch.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        # The least neighbours are at most as many as the edges' ends; one edge has two.
        few = counts(at).rows * 2 <= BROADCAST_ROWS
        marked = F.broadcast if few else (lambda d: d.hint("merge"))
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.put(both.join(marked(low), "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(marked(low), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = scratch.put(hop.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star", mark)
        now = (counts(step).rows, counts(step).more)
        scratch.drop(at, large)
        at = step
        if now == state:
            break
        state = now
    return at.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
