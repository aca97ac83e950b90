"""Connected components of a graph of long ids, kept in DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least id of its component) for each id that ``edges`` (columns a, b) holds.

    By local contraction: in each round every node goes over to the one among its neighbours and itself that is first in an
    order drawn anew for the round, and the edges are carried over to those. That halves the nodes in expectation, whatever
    the graph looks like, so chains, stars and cliques all take rounds as the logarithm of their size, and rounds need no
    bound. Edges only shrink; each round is cut off at the checkpoint folder, so a lost executor costs one round at most.
    Loops and repeated edges do no harm, null ends are passed over, and an empty table gives no rows.
    """
    given = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    nodes = given.select(F.col("a").alias("node")).union(given.select("b")).distinct()
    left = cut(given.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select("a", "b").union(left.select("b", "a"))
        place = lambda x: F.struct(F.xxhash64(x, F.lit(len(moves))).alias("h"), F.col(x).alias("to"))
        near = ends.groupBy("a").agg(F.min(place("b")).alias("best"))
        move = cut(near.select(F.col("a").alias("node"), F.least("best", place("a"))["to"].alias("to")))
        moves.append(move)
        one = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        two = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        carried = left.join(one, "a").join(two, "b").where("x != y")
        before, left = left, cut(carried.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        drop(before)
    if not moves:
        return nodes.select("node", F.col("node").alias("label"))
    # From the last round back: where a node went goes on to where that one went.
    final = moves[-1]
    for move in reversed(moves[:-1]):
        on = final.select(F.col("node").alias("to"), F.col("to").alias("end"))
        final = move.join(on, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    final = cut(final)
    least = final.groupBy("to").agg(F.min("node").alias("label"))
    named = final.join(least, "to").select("node", "label")
    out = cut(nodes.join(named, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    drop(final, left, *moves)
    return out
