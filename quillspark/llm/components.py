"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import stage


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Ties every vertex's neighbours (the smaller ones, or the larger) to the least of them."""
    both = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    if not small:
        both = both.union(both.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least.hint("merge"), "u")
    tied = tied.select(F.col("v").alias("x"), F.col("m").alias("y")).union(least.select(F.col("u").alias("x"), F.col("m").alias("y"))) if small else tied.filter("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    return tied.filter("x != y").distinct()


def components(links: DataFrame) -> DataFrame:
    """(x, y) links -> (x, label): the least vertex that each linked vertex reaches.

    Neighbours are tied to minima in rounds until nothing moves: about the
    logarithm of the longest chain.  Each round is written, so none is
    computed twice.  A vertex's links are reduced to their minimum in each
    task before they move; where many still join it, skewed parts are split.
    """
    edges = stage(links.filter("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    told = None
    while True:
        edges = stage(_star(_star(edges, False), True))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == told:
            break
        told = now
    return edges.select("x", F.col("y").alias("label")).union(edges.select(F.col("y").alias("x"), F.col("y").alias("label")).distinct())
