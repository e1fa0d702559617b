"""Connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import Scratch


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def connected(edges: DataFrame, scratch: Scratch | None = None, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``, long); ``root`` is the smallest node reachable.

    Self-loops and repeated edges change nothing; no edges give no rows. Every
    round writes its edges, at most as many as it was given plus the nodes, and
    the loop ends when a round changes none. Tables go to ``scratch`` where one is given.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    edges = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    for _ in range(rounds):
        # large star: larger neighbours of a node go to the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("at"), F.least("a", "low").alias("low"))
        large = both.join(least, F.col("a") == F.col("at")).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: smaller neighbours of a node and the node itself go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "at")
        moved = large.join(least, F.col("a") == F.col("at")).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = scratch.write(moved.unionByName(least.select(F.col("at").alias("a"), F.col("low").alias("b"))).distinct(), "edges")
        after = _state(edges)
        if after == before:
            roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = after
    raise ValueError(f"no fixed point in {rounds} rounds")
