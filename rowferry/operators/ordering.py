"""Latest-per-key, first-match, paging and id allocation.

``row_number() <= k`` is kept in that plain form on purpose: Spark then limits every group before
the shuffle (``WindowGroupLimit``), so a key holding a third of all rows sends k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.workspace import materialise
from .skew import is_small


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of every key in the given order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, *ties: str) -> DataFrame:
    """The newest row of every key; a missing time counts as oldest."""
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in (time, *ties)])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of every group with their rank."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def by_repeats(df: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key occurs once, rows whose key may be repeated); nulls are equal.

    Hashes of the keys are counted alone. Where few repeat, the rows of the others need not be brought together by key. All rows
    may be repeated where Spark would broadcast them, and so may keys that share a hash.
    """
    if is_small(df):
        return df.limit(0), df
    hashed = F.xxhash64(*keys)
    again = materialise(df.groupBy(hashed.alias("_again")).count().filter(F.col("count") > 1).select("_again"))
    if again.isEmpty():
        return df, df.limit(0)
    return df.join(again, hashed == F.col("_again"), "left_anti"), df.join(again, hashed == F.col("_again"), "left_semi")


def keep_last(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Removes earlier duplicates by an explicit row order."""
    return first_per_key(df, keys, [F.col(c).desc() for c in order])


def first_match(candidates: DataFrame, keys: Sequence[str], priority: str, value: str) -> DataFrame:
    """The value with the smallest priority per key, as a plain aggregate."""
    best = F.min(F.struct(priority, value)).alias("_best")
    return candidates.groupBy(*keys).agg(best).select(
        *keys, F.col(f"_best.{value}").alias(value), F.col(f"_best.{priority}").alias(priority))


def page(
    df: DataFrame, sort: str, direction: str, number: int, size: int, tie: str,
    allowed: Sequence[str] | None = None, largest: int = 100,
) -> DataFrame:
    """One page of rows; size and page number are clamped, the sort column must be a known one."""
    if sort not in (allowed or df.columns):
        raise ValueError(f"unknown sort column: {sort!r}")
    if direction.lower() not in ("asc", "desc"):
        raise ValueError(f"direction must be asc or desc, got {direction!r}")
    size, number = max(1, min(size, largest)), max(1, number)
    order = F.col(sort).asc() if direction.lower() == "asc" else F.col(sort).desc()
    return df.orderBy(order, F.col(tie).asc()).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, size: int, largest: int = 100) -> DataFrame:
    size = max(1, min(size, largest))
    return df.agg(F.count("*").alias("total")).select(
        "total", F.lit(size).cast("bigint").alias("size"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint").alias("pages"))


def newest(df: DataFrame, time: str, tie: str, n: int) -> DataFrame:
    """The newest n rows, missing times last."""
    return df.orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc()).limit(n)


ROWS_PER_RANGE, MOST_RANGES = 100_000, 10_000


def oldest(df: DataFrame, time: str, tie: str, n: int) -> DataFrame:
    """The oldest n rows, missing times first.

    A limit brings them into one task, so for more than a range of them the ages alone are numbered, and the rows up to the n-th
    age are taken where they lie.
    """
    if n <= ROWS_PER_RANGE:
        return df.orderBy(F.col(time).asc(), F.col(tie).asc()).limit(n)
    age = F.struct(time, tie)
    places = allocate_ids(df.select(age.alias("_age")), "_age", "_place", 1)
    edge = places.filter(F.col("_place") == n).select("_age").scalar()
    same = places.filter(F.col("_age") == edge).agg(F.count("*").alias("rows"), F.count_if(F.col("_place") <= n).alias("taken")).first()
    if same["rows"] == 0:  # there are fewer
        return df
    if same["rows"] == same["taken"]:
        return df.filter(age <= edge)
    return df.filter(age < edge).unionByName(df.filter(age == edge).limit(same["taken"]))


def allocate_ids(keys: DataFrame, key: str, column: str, start: int | Column, ranges: int | None = None) -> DataFrame:
    """Consecutive ids in the order of a unique key, without a one-task window.

    Spark samples the keys and deals them into ranges, whose number follows the count (`MOST_RANGES` at most), and each range
    is ordered and written with the places of its rows. The number of rows of each range gives the first id of the next. Ids depend
    on the keys alone, so a retried task or a repeated run gives the same ones, whatever the sample was. Keys may
    be of any type that has an order, and cluster as they like. Keys that Spark would broadcast are numbered in one task.
    """
    if ranges is None and is_small(keys):
        first = start if isinstance(start, Column) else F.lit(start)
        return keys.withColumn(column, (first + F.row_number().over(W.orderBy(key)) - 1).cast("bigint"))
    if ranges is None:
        ranges = max(1, min(MOST_RANGES, -(-keys.count() // ROWS_PER_RANGE)))
    # Partition number and place in the partition, in one number; written, so that both stay what they are.
    ordered = keys.repartitionByRange(ranges, F.col(key)).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(ordered)
    of, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(of.alias("_range")).agg((F.max(place) + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # As many rows as ranges: small enough to broadcast and to order in one task.
    offsets = F.broadcast(counts.select("_range", before.alias("_before")))
    first = start if isinstance(start, Column) else F.lit(start)
    return placed.withColumn("_range", of).join(offsets, "_range").withColumn(
        column, (first + F.col("_before") + place).cast("bigint")).drop("_at", "_range", "_before")
