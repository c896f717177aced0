"""Connected components of a graph given as pairs, by alternating stars over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, staged


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(
        "u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(pairs: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` for every node of ``pairs`` (columns ``u, v``): root is the smallest node reachable.

    Pairs may repeat, run either way or join a node to itself (such a node alone is not listed); pairs with a null are
    left out. Each round writes its edges to the shared folder, so a lost executor costs one round at most. Rounds go
    on until the edges no longer change; all but the last tables are removed.
    """
    edges = staged(pairs.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v").distinct(), label)
    seen = _print_of(edges)
    while seen[0]:
        moved = staged(_small_star(_large_star(edges)), label)
        discard(edges)
        edges, before, seen = moved, seen, _print_of(moved)
        if seen == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
