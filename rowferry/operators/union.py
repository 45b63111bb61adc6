"""Union of frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

# Spark 4.1 lets a union keep the partitioning of its inputs. When adaptive execution then changes the
# partitions of one input only, the job fails with "Can't zip RDDs with unequal numbers of partitions".
_SETTING = "spark.sql.unionOutputPartitioning"


def separate_union_inputs(spark: SparkSession) -> None:
    """Turns that off: inputs may be re-partitioned one by one, as in earlier Spark versions."""
    spark.conf.set(_SETTING, "false")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, matched by column name."""
    separate_union_inputs(frames[0].sparkSession)
    return reduce(DataFrame.unionByName, frames)
