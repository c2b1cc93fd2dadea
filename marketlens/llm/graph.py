"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import attach, materialise


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct links from the larger end (a) to the smaller (b)."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links(a, b), both long -> one row per linked node: node, root (the smallest node it reaches).

    A round sends each node's larger neighbours, and then its smaller ones, to its smallest neighbour; only minima
    are taken, so no node's list of neighbours is ever gathered. Rounds grow with the logarithm of a component's size.
    """
    state, edges = None, materialise(_downward(links), name)
    while True:
        n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, mark) == state or n == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = (n, mark)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("w"))
        large = attach(both.filter("v > u"), lowest, ["u"], "w", 2 * n, F.col("v")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, name)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("w"))
        small = attach(large, lowest, ["a"], "w", n, F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(_downward(small.unionAll(lowest.select("a", F.col("m").alias("b")))), name)
