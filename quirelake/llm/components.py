"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import discard, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours hang on the smallest node around it: its larger neighbours, or its smaller ones and itself.

    The minimum is summed up before the shuffle and joined back, so a hub's neighbours needn't meet in one task.
    """
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        # a: a node, b: any neighbour; larger neighbours move to the least of a and its neighbours
        joined = around.where(F.col("b") > F.col("a")).join(least, "a")
        return joined.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
    joined = edges.join(least, "a")
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node reachable. No edges: no rows.

    Edges are kept as (larger, smaller). Each round is written to the shared folder, which cuts lineage; rounds
    grow with the logarithm of the longest path. Self-loops and nulls give nothing.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges"
    )

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    was = mark(now)
    while True:
        last, now = now, written(_stars(_stars(now, large=True), large=False), "edges")
        discard(last)
        seen = mark(now)
        if seen == was:
            break
        was = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
