"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm.common import materialize


def _oriented(pairs: DataFrame) -> DataFrame:
    """Distinct edges with the larger node first."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node that it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _oriented(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.unionByName(least.withColumnRenamed("m", "b")))


def _state(edges: DataFrame) -> tuple[int, int]:
    seen = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return seen.n, seen.x or 0


def connected_components(pairs: DataFrame) -> DataFrame:
    """pairs (a, b: bigint) -> (node, root): the smallest node reachable, for nodes other than roots.

    Each round is two aggregations and two equi-joins; a hub's edges meet one row, so a skewed join can be
    split. Rounds are logarithmic in the longest chain. The lineage is cut each round. Empty input, loops
    and repeated edges give what they should: no rows, nothing, one edge.
    """
    edges = materialize(_oriented(pairs))
    state = _state(edges)
    while state[0]:
        edges = materialize(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
