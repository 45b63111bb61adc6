"""Sends the package to the executors, whose Python workers run its functions."""

from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


@lru_cache(maxsize=None)
def _archive() -> str:
    path = Path(tempfile.mkdtemp(prefix="rowferry-code-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(PACKAGE.parent))
    return str(path)


@lru_cache(maxsize=None)
def _sent(application: str) -> None:
    SparkContext.getOrCreate().addPyFile(_archive())


def ship(spark: SparkSession) -> None:
    """Makes the package importable in every Python worker, once for an application."""
    _sent(spark.sparkContext.applicationId)
