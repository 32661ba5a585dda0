"""Connected components of an edge table by alternating large and small stars, each round a written table.

Defined results: an edge with a null node, or from a node to itself, links nothing; repeated edges count once; an empty table has no
components. Edges that do not settle in MAX_ROUNDS rounds (a path of about 2^MAX_ROUNDS nodes) raise RuntimeError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges(a, b) but the roots; the root is the smallest node of its component.

    A row goes to its node's neighbour minimum, which partial aggregation finds; the joins that follow are plain equi joins,
    so a node with very many edges is split by adaptive skew handling. Rounds grow with the logarithm of the longest path.
    """
    edges = written(edges.filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        if (now := _state(edges)) == before or not now[0]:
            break
        large = written(_large(edges), "large")
        dropped(edges)
        before, edges = now, written(_small(large), "small")
        dropped(large)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
