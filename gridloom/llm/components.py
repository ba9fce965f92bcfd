"""Connected components of a table of links, by alternating stars of least ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import discard, materialize
from gridloom.llm.skew import join_hot


def _star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's neighbours are linked to the least of node and neighbours; ``links`` run from ``a`` to ``b``.

    Gives the links and the written table of least nodes that they read.
    """
    least = materialize(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
    return join_hot(links, least, ["a"]), least


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node reachable, for every node of a link (``a``, ``b``).

    Large stars and small stars alternate until the links stand still, which takes about the logarithm of the number
    of nodes in rounds. A hub's links meet in no row and no task; every round is a written table.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        large, least = _star(both(edges))
        large = large.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "large-stars")
        discard(least)
        small, least = _star(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, edges = edges, materialize(small, "links")
        discard(before, large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == now:
            break
        mark = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
