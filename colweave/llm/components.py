"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, "a").where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; root is the smallest node reachable.

    Loops and repeated edges are allowed; an empty table gives an empty table.
    Each half-round is one aggregate and one join on the node, where a hub is one
    combined row on one side and plain rows on the other, so AQE can split it.
    The number of rounds grows with the logarithm of the longest chain.
    Every round is a written table: a lost executor costs one round.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct())
    state = _state(edges)
    while state[0]:
        edges = materialise(_small_star(materialise(_large_star(edges))))
        now = _state(edges)
        if now == state:
            break
        state = now
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
