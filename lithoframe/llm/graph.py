"""Connected components of an edge table by alternating stars, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest neighbour, until nothing
    changes. Minima are combined before the shuffle, so a node of many edges costs a row per task.
    """
    now = cut(_tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    mark = _mark(now)
    while True:
        now = cut(_small_star(_large_star(now)))
        was, mark = mark, _mark(now)
        if was == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select("b", "b").distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, the larger node first; no loops."""
    return (edges.filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _tidy(both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _tidy(moved.union(least.select("a", "m")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
