"""Published table versions: a failed run leaves the last version in place."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import is_missing


class Snapshots:
    """Versions of one table below a folder.

    A version is a folder of its own and is never changed after its number was appended to the version
    list, so readers keep a consistent table and nothing is read and overwritten in one plan.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _newest(self) -> tuple[int, str] | None:
        try:
            listed = self.spark.read.schema("version bigint, folder string").parquet(f"{self.root}/_list")
        except AnalysisException as error:
            if not is_missing(error):
                raise
            return None
        # Two publishers may take the same number; their folders differ, and every reader picks the same one.
        found = listed.agg(F.max(F.struct("version", "folder")).alias("newest")).first()["newest"]
        return None if found is None else (found["version"], found["folder"])

    def version(self) -> int | None:
        newest = self._newest()
        return None if newest is None else newest[0]

    def current(self) -> DataFrame | None:
        newest = self._newest()
        return None if newest is None else self.spark.read.parquet(f"{self.root}/{newest[1]}")

    def publish(self, df: DataFrame) -> int:
        version = (self.version() or 0) + 1
        folder = f"v{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        self.spark.range(version, version + 1, numPartitions=1).select(
            F.col("id").alias("version"), F.lit(folder).alias("folder")).write.mode("append").parquet(f"{self.root}/_list")
        return version


def rebuild(stores: dict[str, Snapshots], empty: dict[str, DataFrame], lookups: set[str]) -> list[str]:
    """Publishes an empty version of every table the delivery writes; lookup tables stay."""
    cleared = [name for name in stores if name not in lookups]
    for name in cleared:
        stores[name].publish(empty[name])
    return cleared
