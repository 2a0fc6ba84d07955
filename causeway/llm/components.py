"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component for every node of edges (src, dst: long); component is the smallest node reachable.

    Each round joins every edge to the smallest neighbour of one of its ends, so edges contract towards one star
    for each component. Rounds go on until none changes the edge table; the edges stay in the shared checkpoint
    folder between rounds. Nodes with many edges are pre-aggregated (min) and joined, never gathered. Loops and
    repeated edges do no harm; nulls are dropped; no edges give no rows.
    """

    def marked(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = cut(e.distinct())
        return e, tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e, mark = marked(
        edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    )
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour moves to the smallest node around
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, new = marked(moved.unionByName(low.select("u", F.col("m").alias("v"))))
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
