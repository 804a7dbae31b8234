"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.plans.scratch import drop, written


def _star(edges: DataFrame, upper: bool) -> DataFrame:
    """Point the neighbours of each node at the smallest node of its neighbourhood.

    ``upper`` moves the larger neighbours (large star), else the smaller ones
    and the node itself (small star).  ``edges`` hold ``a`` > ``b``.
    """
    if upper:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = (
            edges.join(least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
        )
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an undirected edge table (src, dst).

    The component is its smallest node.  Large and small stars alternate until
    the edges are stars around those nodes; the rounds grow with the logarithm
    of the longest path.  Each round is a written table, so a lost executor
    costs one round at most.  Nodes without edges are not returned; loops and
    repeated edges are allowed.
    """
    now = written(
        edges.select(
            F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")
        ).where("a <> b").distinct(),
        "edges",
    )

    def state(df: DataFrame):
        return tuple(
            df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )

    before = state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        after_df = written(_star(_star(now, True), False), "edges")
        drop(now)
        now = after_df
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select("b", "b").distinct()
    )
