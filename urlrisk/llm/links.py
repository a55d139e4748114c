"""Connected components of links, by star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import stored


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one root and no root has one."""
    children = edges.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    bad = children.where(F.col("n") > 1).select("node").unionAll(
        edges.select(F.col("root").alias("node")).distinct().join(children.select("node"), "node", "left_semi"))
    return bad.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots, which are the smallest nodes of their components.

    ``links`` has two columns of node numbers, in any order, with or without repeats and self-links. Each
    round hangs the larger neighbours of every node on its smallest one, then the smaller ones; the number
    of rounds grows with the logarithm of the longest chain. A round is a few shuffles of the remaining
    links, which never grow in number, and is written to shared storage; nothing is collected.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    edges = stored(links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node > root").distinct(), "links")
    while not _is_forest_of_stars(edges):
        both = edges.unionAll(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("_m")).select("node", F.least("node", "_m").alias("_m"))
        large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("_m").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("_m"))
        moved = large.join(least, "node")
        small = moved.select("node", F.col("_m").alias("root")).unionAll(
            moved.where("root != _m").select(F.col("root").alias("node"), F.col("_m").alias("root")))
        edges = stored(small.where("node > root").distinct(), "links")
    return edges
