"""Connected components by alternating large-star and small-star steps.

Each step is a partially aggregated minimum and an equi-join that AQE may split
when a node is hot, so a hub never has to fit one task.  The edge set is cut to
a written table after every round; the number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.shiftright(F.xxhash64("a", "b"), 16)), F.lit(0)).alias("s"),
    ).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``: every node with an edge, and the least node it reaches.

    Self-loops and repeated or reversed edges are fine; an empty edge set gives
    an empty result.  Raises if it has not settled after ``max_rounds`` rounds.
    """
    current = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    before = _signature(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        current = written(_small_star(_large_star(current)), "edges")
        after = _signature(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
