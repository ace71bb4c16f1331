"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.llm.common import lookup_join, stored


def _least(arcs: DataFrame) -> DataFrame:
    """Per node ``a`` the least of itself and its neighbours."""
    return stored(arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star-least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's least neighbour."""
    arcs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = lookup_join(arcs, _least(arcs), ["a"], "inner")
    return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the least of them."""
    joined = lookup_join(edges, _least(edges), ["a"], "inner")
    return joined.select("a", F.col("m").alias("b")).unionByName(
        joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node of its component.

    Each round writes its edges to the shared folder and the loop ends when
    a round changes nothing; the number of rounds is logarithmic in the longest path.
    """
    def oriented(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(oriented(edges), "star-edges")
    seen = mark(now)
    while seen[0]:
        now = stored(oriented(_small_star(stored(oriented(_large_star(now)), "star-large"))), "star-edges")
        before, seen = seen, mark(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
