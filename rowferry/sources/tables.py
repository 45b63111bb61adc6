"""Table scans, counts and append sinks. Spark prunes columns and pushes filters by itself."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.union import union_all

BATCH_ROWS = 1000  # Fixed value: rows per round trip of a database read or write.


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, format: str = "parquet") -> DataFrame:
    df = spark.read.format(format).load(path)
    return df.select(*columns) if columns else df


def scan_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def scan_jdbc(
    spark: SparkSession, url: str, table: str, key: str, low: Any, high: Any, partitions: int,
    columns: Sequence[str] | None = None, options: dict[str, str] | None = None,
) -> DataFrame:
    """Database table, read by key ranges in parallel."""
    df = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high),
        numPartitions=str(partitions), fetchsize=str(BATCH_ROWS), **(options or {})).load()
    return df.select(*columns) if columns else df


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table; parquet answers these from its footers."""
    return union_all(*[df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
                       for name, df in tables.items()])


def since(df: DataFrame, time: str, after: Column) -> DataFrame:
    """Rows changed after a moment. No sort: merges downstream do not depend on row order."""
    return df.filter(F.col(time) > after)


def feed_since(feed: DataFrame, entity: str, after: Column) -> DataFrame:
    """Change-feed rows of one entity after a moment, in order."""
    return since(feed.filter(F.col("source_entity") == entity), "created_at", after) \
        .orderBy("created_at", "event_id")


def append(df: DataFrame, path: str, format: str = "parquet") -> None:
    df.write.format(format).mode("append").save(path)


def append_jdbc(df: DataFrame, url: str, table: str, options: dict[str, str] | None = None) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(BATCH_ROWS), **(options or {})) \
        .mode("append").save()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path) \
        .select("path", F.sha2("content", 256).alias("sha256"))
