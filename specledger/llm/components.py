"""Connected components of a large edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from specledger.session import stage_table


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node of the edges (``a``, ``b``): two nodes are connected exactly if their roots are equal.

    In each round every node moves to the neighbour (or itself) that comes first in a random order, and the edges move along; the
    edge from a node to its target keeps the two connected. The order is a fresh hash in each round, so long chains shrink by a
    constant factor whatever their ids. Rounds end when no edge is left. Every round is a staged table: nothing is gathered,
    and a lost executor repeats one round at most.
    """
    edges = stage_table(edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .distinct(), "edges")
    moves = None
    turn = 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = stage_table(best.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("to")), "step")
        left = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").filter("ta <> tb")
        edges = stage_table(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if moves is None:
            moves = step.select("node", F.col("to").alias("root"))
        else:
            later = step.select(F.col("node").alias("root"), "to")
            moves = stage_table(moves.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        turn += 1
    if moves is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return moves
