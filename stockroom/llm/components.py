"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.common import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(directed: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of every node ``a`` on the smallest node around it.

    Large star moves the neighbours greater than ``a``; small star moves ``a`` itself and
    the neighbours smaller than it.  Minima are map-side combined, and the join back
    carries single edges, so a node with very many neighbours is never held in one row.
    """
    lowest = directed.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    around = directed.join(lowest, "a")
    if large:
        moved = around.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = around.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            lowest.select("a", F.col("low").alias("b"))
        )
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest reachable node.

    Each round is checkpointed to the shared folder.  The rounds end when an edge set
    repeats, which is when every node hangs directly on its root.  Empty edges give no rows.
    """
    now = checkpointed(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    mark = None
    while True:
        after_large = _star(_both_ways(now), large=True)
        down = after_large.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        now = checkpointed(_star(down, large=False))
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == (seen["n"], seen["s"]):
            break
        mark = (seen["n"], seen["s"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
