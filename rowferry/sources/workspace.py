"""Shared folder for checkpoints, staged tables and snapshots."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
# Fixed value: frames that are written at a time.
WRITERS = 4


class SharedFolderError(RuntimeError):
    """No folder that the driver and all executors can see."""


@lru_cache(maxsize=None)
def _own_folder(application: str) -> str:
    """A folder of one local process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="rowferry-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def base_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; only a local master may do without the setting."""
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise SharedFolderError(f"set {_SETTING} to a folder that the driver and all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A new folder; everything one application leaves there lies under its id, see `release`."""
    return f"{base_folder(spark)}/rowferry/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Removes what this application has staged; frames read from there are of no use afterwards."""
    discard(spark, f"{base_folder(spark)}/rowferry/{spark.sparkContext.applicationId}")


def is_missing(error: AnalysisException) -> bool:
    """True when a read failed because nothing has been written to the path yet."""
    return error.getCondition() == "PATH_NOT_FOUND"


def staged(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes a frame and reads it back; with the folder, for `discard`."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame) -> DataFrame:
    """Writes a frame that several branches share and reads it back.

    The copy is on shared storage, so losing an executor does not recompute the branch.
    """
    return staged(df)[0]


def materialise_all(*frames: DataFrame) -> list[DataFrame]:
    """Frames that do not depend on each other, written side by side: the small ones do not wait for the large."""
    with ThreadPoolExecutor(WRITERS) as pool:
        return list(pool.map(materialise, frames))


def discard(spark: SparkSession, path: str) -> None:
    """Removes a staged copy that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
