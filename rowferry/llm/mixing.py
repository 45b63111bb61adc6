"""Mixing sources to target weights by capped water-filling.

All words are shared out among the sources by weight. A source stops at a highest number of epochs
of its own size, and what it cannot take is shared again by weight until none is above. A source then repeats
each document a whole number of times, and the rest of its target goes to documents in a seeded random order, whole
documents until the target is met as nearly as whole documents can.

Null texts have size 0; null is a source of its own, after all others. Documents without words are repeated
whole times only. Rows of equal id are told apart by size; equal rows may take each other's place without
a difference in the result. An empty table gives an empty result. Only built-in column functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.workspace import materialise

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
_BITS = 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def draw(key: Column, seed: str) -> Column:
    """A number of 52 bits from the seed and the key: the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("bigint")


def ranked_sources(sized: DataFrame) -> DataFrame:
    """One row per source with its place in code point order; ordered by ranges, not in one task."""
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialise(sums.repartitionByRange(parts, F.col("source").asc_nulls_last())
                          .withColumn("_part", F.spark_partition_id()))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return ordered.join(counts.select("_part", before.alias("_before")), "_part").select(
        "source", "source_size", "n_docs", (F.col("_before") + inside - 1).cast("bigint").alias("rank"))


def fill(sources: DataFrame, most_epochs: int) -> float:
    """The water level: words per unit of weight for sources below their cap.

    Each round is one sum over the sources. The level rises and sources only join the full ones, so
    the rounds end with the number of full sources unchanged.
    """
    cap, weight, level, full = F.col("source_size") * most_epochs, F.col("weight"), None, 0
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        above = F.lit(False) if level is None else cap.cast("double") < weight * F.lit(level)
        taken, left, now = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, weight)), F.lit(0)),
            F.count(F.when(above, 1))).first()
        if left == 0 or (level is not None and now == full):
            return level or 0.0
        level, full = float(total - taken) / left, now


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """Every row's id with `size`, `source_size`, `target` of its source, `copies` and `taken` words."""
    row = F.monotonically_increasing_id()
    sized = materialise(docs.select(docs[key].alias("_id"), docs[source].alias("source"), word_count(docs[text]).alias("size"))
                        .withColumn("draw", draw(F.col("_id"), seed)).withColumn("_row", row))
    return _mixed(sized, weights, most_epochs).select(
        F.col("_id").alias(key), "size", "source_size", "target", "copies", "taken")


def _mixed(sized: DataFrame, weights: Sequence[int], most_epochs: int) -> DataFrame:
    ranks = ranked_sources(sized)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialise(ranks.withColumn("weight", weight))
    level = fill(sources, most_epochs)
    largest = sources.agg(F.max("n_docs")).first()[0] or 1
    # As many bins as rows in a bin for the largest source: neither the bins of a source nor the rows of a bin pile up.
    shift = _BITS - max(0, math.ceil(math.log2(largest) / 2))
    cap = (F.col("source_size") * most_epochs).cast("double")
    target = F.when(cap < F.col("weight") * F.lit(level), cap).otherwise(F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = sources.withColumn("target", target).withColumn("whole", F.floor(rate).cast("bigint")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")).select(
        F.col("source").alias("_source"), "rank", "source_size", "target", "whole", "rest")
    rows = sized.join(planned, sized["source"].eqNullSafe(planned["_source"])).drop("_source").withColumn(
        "_bin", F.shiftright("draw", shift))
    bins = rows.groupBy("rank", "_bin").agg(F.sum("size").alias("_sum"))
    lower = F.coalesce(F.sum("_sum").over(W.partitionBy("rank").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = bins.select("rank", "_bin", lower.alias("_lower"))
    order = W.partitionBy("rank", "_bin").orderBy("draw", "_id", "size", "_row").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_lower") + F.coalesce(F.sum("size").over(order), F.lit(0))
    placed = rows.join(offsets, ["rank", "_bin"]).withColumn("_before", before)
    extra = (F.col("size") > 0) & (2 * F.col("_before") + F.col("size") <= 2 * F.col("rest"))
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    return placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def repeat(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
           weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, all columns as they were.

    Rows that agree in id, source and text are one document given several times.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in (key, source)],
                       F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("_row")
    sized = materialise(docs.select(name, docs[key].alias("_id"), docs[source].alias("source"), word_count(docs[text]).alias("size"))
                        .withColumn("draw", draw(F.col("_id"), seed)))
    copies = _mixed(sized, weights, most_epochs).groupBy("_row").agg(F.sum("copies").cast("int").alias("_copies"))
    rows = docs.withColumn("_row", name).dropDuplicates(["_row"]).join(copies.filter("_copies > 0"), "_row")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
