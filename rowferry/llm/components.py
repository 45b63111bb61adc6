"""Connected components of an edge table, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.union import union_all
from ..sources.workspace import materialise


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds a second key to join on. The join then deals its sides anew instead of following the aggregate of one of
    them, and adaptive execution can split a vertex with very many edges."""
    return rows.withColumn("_again", F.xxhash64("u"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of every vertex to the smallest of its neighbourhood."""
    both = union_all(edges, edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_least")).withColumn("_least", F.least("u", "_least"))
    return _keyed(both).join(_keyed(least), ["_again", "u"]).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a vertex and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("_least"))
    others = _keyed(edges).join(_keyed(least), ["_again", "u"]).filter(F.col("v") != F.col("_least")).select(F.col("v").alias("u"), F.col("_least").alias("v"))
    return union_all(others, least.select("u", F.col("_least").alias("v")))


def _downward(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(`u`, `root`) for every vertex with an edge that is not the smallest of its component.

    A round is a few aggregates and joins and its result is written, so lineage stays short; the number of
    rounds grows with the logarithm of the longest path. Only the decision to stop reaches the driver.
    """
    current = materialise(_downward(edges.select("u", "v")))
    while not _are_stars(current):
        current = materialise(_downward(_small_star(_downward(_large_star(current)))))
    return current.select("u", F.col("v").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex has one edge down and what it leads to has none."""
    below = edges.groupBy("u").agg(F.count("*").alias("n"))
    return below.filter("n > 1").isEmpty() and edges.select("v").distinct().join(
        below, F.col("v") == F.col("u"), "left_semi").isEmpty()
