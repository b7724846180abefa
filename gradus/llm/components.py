"""Connected components of a link table by iterated joins; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id reachable, itself included.

    Alternates large-star and small-star steps, each a grouping by node with a minimum, until the links are stable;
    then every link goes from a node to its component's smallest. A node's neighbours are never collected: the
    minimum is joined back, so a hot node is a skewed join that Spark may split.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node go to its smallest
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large)
        # small star: neighbours below a node, and itself, go to its smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        small = staged(small)
        changed = small.exceptAll(edges).limit(1).count() or edges.exceptAll(small).limit(1).count()
        edges = small
        if not changed:
            break
    else:
        raise RuntimeError(f"components not stable after {rounds} rounds")
    nodes = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return nodes.union(roots)
