"""Connected components of an edge table, by random-priority contraction.

In each round every node moves to the neighbour (or itself) of least random priority, and edges are renamed to the
targets; a constant share of the nodes goes away in each round, so rounds grow with the logarithm of the node count,
long chains and stars included. No round collects a neighbourhood: minima combine before the shuffle, and the renaming
joins are plain equi-joins whose hot keys adaptive execution splits. Nothing but an emptiness test reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, few


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root) for the nodes of the edges; nodes of one component share a root, some node of it."""
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found, turn, n = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0), 0, edges.count()
    while n:
        turn += 1
        both = edges.union(edges.select("b", "a"))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("p"), "b")).alias("m"))
        own = F.struct(F.xxhash64("node", F.lit(turn)).alias("p"), F.col("node").alias("b"))
        moves = cut(few(best.select("node", F.least(own, "m")["b"].alias("to")), n))
        at = moves.withColumnRenamed("node", "n")
        if turn == 1:
            found, nodes = moves.withColumnRenamed("to", "root"), n
        else:
            found = cut(few(found.join(at, F.col("root") == F.col("n"), "left").select("node", F.coalesce("to", "root").alias("root")), nodes))
        one = edges.join(at, F.col("a") == F.col("n")).select(F.col("to").alias("a"), "b")
        two = one.join(at, F.col("b") == F.col("n")).select("a", F.col("to").alias("b")).filter("a <> b")
        edges = cut(few(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n))
        n = edges.count()
    return found
