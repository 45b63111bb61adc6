"""State of many tables that changes by whole batches.

A batch writes the changed rows of every table it touches into new folders and then one manifest, named by the batch, that
lists the folders in force. Readers follow the newest manifest, so they see all of a batch or nothing of it, and a
batch that is repeated finds its manifest, or starts again from the one before. A table is its oldest folder with the later
ones laid over it, newest row per key; when there are many, or together they would be as large as the oldest, the commit writes
the table anew, the changed rows with it. A row is therefore rewritten a number of times that grows with the logarithm of the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import by_repeats, first_per_key
from ..operators.union import union_all
from ..sources.workspace import WRITERS, discard, is_missing

MOST_FOLDERS = 8
_MANIFEST = "name string, at int, folder string, rows bigint"


class Commits:
    """Tables below a folder; `keys` names each table's key columns."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, Sequence[str]]):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keys = {name: list(columns) for name, columns in keys.items()}

    def _manifest(self, batch: int) -> dict[str, list[tuple[str, int]]]:
        """Folders of every table with their numbers of rows, oldest first; some per table."""
        found: dict[str, list[tuple[str, int]]] = {}
        listed = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/_commits/batch={batch}")
        for r in listed.orderBy("name", "at").collect():
            found.setdefault(r["name"], []).append((r["folder"], r["rows"]))
        return found

    def batches(self) -> list[int]:
        """Batches that were committed, ascending. A manifest is one file, so it is there or not."""
        try:
            listed = self.spark.read.schema(f"{_MANIFEST}, batch bigint").parquet(f"{self.root}/_commits")
        except AnalysisException as error:
            if not is_missing(error):
                raise
            return []
        return sorted(r["batch"] for r in listed.select("batch").distinct().collect())

    def done(self, batch: int) -> bool:
        return batch in self.batches()

    def start(self, tables: dict[str, DataFrame]) -> None:
        """The state before the first batch; a state that is there already stays."""
        if not self.batches():
            self._write(-1, {}, tables)

    def read(self, before: int | None = None) -> dict[str, DataFrame]:
        """All tables after the last batch, or after the last one before the given number."""
        batches = [b for b in self.batches() if before is None or b < before]
        return {name: self._table(name, folders) for name, folders in self._manifest(batches[-1]).items()}

    def _table(self, name: str, folders: list[tuple[str, int]]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.root}/{folder}") for folder, _ in folders]
        if len(parts) == 1:
            return parts[0]
        # What was laid over is small: it is brought to one row per key, and the oldest folder is read past it.
        later = union_all(*[p.withColumn("_at", F.lit(k)) for k, p in enumerate(parts[1:])])
        newest = first_per_key(later, self.keys[name], [F.col("_at").desc()]).drop("_at")
        rest = parts[0].join(newest.select(*self.keys[name]), self.keys[name], "left_anti").select(*parts[0].columns)
        return union_all(rest, newest)

    def commit(self, batch: int, changed: dict[str, DataFrame]) -> bool:
        """Lays changed rows over the state; False if the batch was committed before, and nothing is done."""
        batches = self.batches()
        if batch in batches:
            return False
        before = [b for b in batches if b < batch]
        self._write(batch, self._manifest(before[-1]), changed)
        if len(before) > 1:  # readers of the last state but one may still be at work, those of earlier ones are not
            kept = {f for b in (batch, *before[-1:]) for folders in self._manifest(b).values() for f, _ in folders}
            for folder in {f for folders in self._manifest(before[-2]).values() for f, _ in folders} - kept:
                discard(self.spark, f"{self.root}/{folder}")
        return True

    def _write(self, batch: int, before: dict[str, list[tuple[str, int]]], changed: dict[str, DataFrame]) -> None:
        def stored(name: str) -> list[tuple[str, int]]:
            rows, folders = changed[name], before.get(name)
            if folders is None:
                return [self._store(name, batch, rows)]
            count = rows.count()
            if not count:
                return folders
            if len(folders) < MOST_FOLDERS and sum(n for _, n in folders[1:]) + count < folders[0][1]:
                return [*folders, self._store(name, batch, rows)]
            keys = self.keys[name]
            single, several = by_repeats(rows, *keys)
            rows = union_all(single, first_per_key(several, keys, [F.col(k) for k in keys]))
            if any(n for _, n in folders):
                rows = union_all(self._table(name, folders).join(rows.select(*keys), keys, "left_anti").select(*rows.columns), rows)
            return [self._store(name, batch, rows)]

        with ThreadPoolExecutor(WRITERS) as pool:  # tables do not depend on each other
            after = before | dict(zip(changed, pool.map(stored, changed)))
        rows = [(name, k, folder, n) for name, folders in after.items() for k, (folder, n) in enumerate(folders)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_commits/batch={batch}")

    def _store(self, name: str, batch: int, rows: DataFrame) -> tuple[str, int]:
        folder = f"{name}/{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return folder, self.spark.read.parquet(f"{self.root}/{folder}").count()
