"""Equality joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOINS = ("left", "inner", "left_semi", "left_anti")
LEAST_SHARE, TRACKED = 0.001, 10_000
"""No smaller share is looked for; keys that the sketch of a task keeps apart. Its error is far below that share."""


def is_small(df: DataFrame) -> bool:
    """Whether Spark's own estimate of a frame's size is below what it would broadcast."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def key_shares(df: DataFrame, key: str, share: float) -> list[tuple[Any, float]]:
    """Keys, null among them, with at least the given share of all rows, and their share.

    One pass with a sketch of the frequent keys per task, merged in one row: no key is shuffled. At most 1 / share
    keys come back, and one row reaches the driver.
    """
    share = max(share, LEAST_SHARE)
    most = math.ceil(1 / share)
    found = df.agg(F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"),
                   F.expr(f"approx_top_k(`{key}`, {most}, {max(TRACKED, 4 * most)})").alias("top")).first()
    counts = [(r["item"], r["count"]) for r in found["top"] or [] if r["item"] is not None]
    counts += [(None, found["nulls"])] if found["nulls"] else []
    return [(value, n / found["n"]) for value, n in counts if n >= share * found["n"]]


def heavy_keys(df: DataFrame, key: str, share: float = 0.02) -> DataFrame:
    """Keys, null among them, holding at least the given share of all rows: at most 1 / share."""
    return df.sparkSession.createDataFrame([(value,) for value, _ in key_shares(df, key, share)],
                                           T.StructType([T.StructField(key, df.schema[key].dataType)]))


def spread_join(
    rows: DataFrame, other: DataFrame, key: str, how: str = "left", spread_by: Sequence[str] | None = None,
    copies: int | None = None, share: float | None = None, weigh: DataFrame | None = None,
) -> DataFrame:
    """Join of many rows to a keyed frame, with heavy keys cut into parts.

    Key shares are looked at first, over `weigh` where a cheaper frame with the same keys exists, unless the rows are few
    enough to be broadcast. Without a heavy key this is a plain join. Otherwise the rows of heavy keys get a part from a hash of their
    values, which keeps a recomputed task identical, and the other side repeats just those keys. A key is heavy from half of an
    even task's rows on (one hundredth at most), and has a part for each such half, or `copies` of them where given.
    A heavy null key matches nothing and is only parted.
    """
    if how not in JOINS:
        raise ValueError(f"unsupported join type {how!r}")
    if copies is None and share is None and is_small(rows):
        return rows.join(other, key, how)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    least = min(0.01, 1 / (2 * tasks)) if share is None else share
    heavy = key_shares(rows if weigh is None else weigh, key, least)
    if not heavy:
        return rows.join(other, key, how)
    parts = [(value, copies or max(2, math.ceil(2 * tasks * held))) for value, held in heavy]
    # At most 1 / LEAST_SHARE rows by construction.
    table = F.broadcast(rows.sparkSession.createDataFrame(parts, T.StructType([
        T.StructField("_heavy", rows.schema[key].dataType), T.StructField("_parts", T.IntegerType())])))
    draw = F.xxhash64(*(spread_by or rows.columns))
    parted = rows.join(table, F.col(key).eqNullSafe(F.col("_heavy")), "left").withColumn(
        "_part", F.coalesce(F.pmod(draw, F.col("_parts")), F.lit(0)).cast("int")).drop("_heavy", "_parts")
    every = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    copied = other.join(table, F.col(key).eqNullSafe(F.col("_heavy")), "left").withColumn(
        "_part", F.explode(every)).drop("_heavy", "_parts")
    return parted.join(copied, [key, "_part"], how).drop("_part")
