"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqspark.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to the least vertex around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(vertex, component)`` of every vertex with an edge; the component is its least vertex.

    ``edges(a, b)`` of longs, in either direction, repeated or not; loops are ignored and an empty
    table gives an empty one. Alternating large and small stars: a number of rounds in the order of
    the squared logarithm of the largest component, each a few aggregations that combine before they
    shuffle. Each round is written to the shared folder in place of the one before, so no lineage grows
    and a lost executor costs one round at most. Only two numbers a round reach the driver.
    """
    edges = materialize(_clean(edges.select("a", "b")), "edges")
    state = None
    for _ in range(max_rounds):
        n, mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if n == 0 or (n, mark) == state:
            break
        state = (n, mark)
        edges = materialize(_clean(_small_star(_clean(_large_star(edges)))), "edges", instead_of=edges)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(roots)
