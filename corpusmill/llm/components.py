"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``links(a, b)``.

    A component is named by its smallest node.  Alternates the large-star and
    small-star steps: every node's neighbours move to the smallest of them.
    Each round is stored, so a lost executor costs one round.  Rounds grow with
    the logarithm of the size; ``most_rounds`` only guards against endless loops.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: greater neighbours of u, linked to the smallest node around u.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # Small star: u's smaller neighbours, and u, linked to the smallest of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = stored(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        # A sum of hashes tells one round's edges from the next one's.
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(found):
            break
        mark = tuple(found)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
