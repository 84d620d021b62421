"""Connected components of an edge table, in rounds of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or else the smaller) neighbours of every node to its least neighbour or itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        lower = both.filter("b < a")
        least = lower.groupBy("a").agg(F.min("b").alias("m"))
        linked = lower.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame, tag: str, most_rounds: int = 40) -> DataFrame:
    """node, component (the least node of it) for every node with an edge; ``edges`` has longs a and b.

    Each round is written to the shared folder, so lineage stays short and lost executors cost one round.
    """
    now = common.stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    mark = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == mark or not state["n"]:
            break
        mark = state
        now = common.stored(_star(_star(now, True), False), tag)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
