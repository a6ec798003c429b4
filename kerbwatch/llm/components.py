"""Connected components of a graph of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwatch.session import staged


def _in_order(column: str, turn: int) -> Column:
    """The node, sorting by a hash that differs from round to round."""
    return F.struct(F.xxhash64(column, F.lit(turn)).alias("h"), F.col(column).alias("n"))


def connected_components(links: DataFrame, name: str = "links") -> DataFrame:
    """`node`, `root` for every end of a link (columns `a`, `b`, any comparable kind).

    In a round every node moves to the one of itself and its neighbours that comes first in the
    round's own hash order, and links follow. That keeps what is connected connected, and shrinks
    any component by a constant factor a round on average, a star or a chain alike. Rounds are
    written tables, so lineage stays short and a lost executor costs a re-read. A node with very many
    links is combined before each shuffle; where it is a join key, the rows of one key are split by
    Spark's skewed-join handling. `root` is one node of the component, the same for all.
    """
    moves: list[DataFrame] = []
    ends = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ends = staged(ends.distinct(), name)
    while not ends.isEmpty():
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(_in_order("b", len(moves))).alias("near"))
        first = F.least("near", _in_order("a", len(moves)))["n"]
        move = staged(nearest.select(F.col("a").alias("node"), first.alias("to")), name)
        moves.append(move)
        left = move.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = ends.join(left, "a").join(right, "b").filter("to_a <> to_b")
        ends = staged(
            moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(),
            name,
        )
    if not moves:
        return ends.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[-1].select("node", F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        later = found.select(F.col("node").alias("to"), "root")
        found = move.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return found
