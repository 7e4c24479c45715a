"""Connected components by randomised contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import release, settle


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another node.

    Each round gives every node a fresh pseudo-random rank, points it at the
    lowest-ranked node among itself and its neighbours, and contracts the edges
    along these pointers. The minimum is a partial aggregate and the joins carry
    one unique side, so that a hub's edges may be split among tasks. Components
    shrink by a constant factor a round, whatever their shape. Null ends are
    no nodes; loops and repeated edges are dropped. No table reaches the
    driver or is broadcast.
    """
    pair = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    pair = settle(pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    turn = 0
    while not pair.isEmpty():
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        both = pair.union(pair.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("n"))
        step = settle(nearest.select(F.col("a").alias("node"), F.least("m", own)["n"].alias("to")))
        ends = (
            pair.join(step.select(F.col("node").alias("a"), F.col("to").alias("pa")).hint("merge"), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("pb")).hint("merge"), "b")
            .where("pa <> pb")
        )
        last = pair
        pair = settle(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if labels is None:
            labels = settle(step.select("node", F.col("to").alias("root")))
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            joined = labels.join(moved.hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            old, labels = labels, settle(joined)
            release(old)
        release(last, step)
        turn += 1
    if labels is None:
        return pair.select(F.col("a").alias("node"), F.col("b").alias("root"))
    release(pair)
    return labels
