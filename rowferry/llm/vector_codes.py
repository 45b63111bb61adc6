"""Product codes of vectors, learnt with active-entry Lloyd rounds.

Vectors are cut into equal parts; every part is replaced by the number of the nearest entry of its codebook. A round
assigns all parts and moves every entry to the mean of its parts. Between rounds each row keeps its entries and the
exact distances to them. A part whose entry did not move can only be drawn away by an entry that did, so it is
compared with the moved entries alone; the other parts are compared with all of them. Equal distances go to the
entry with the lower index, against stored distances too, so the result is that of complete rounds.

All arithmetic is on whole numbers. Only codebooks and their sums, which do not grow with the rows, reach the driver;
every round's rows are written to the shared folder and the round before is removed.

Rows whose vector is null or holds a null or non-finite component take no part. Vectors must have one length; rows with
another length than the vector of the smallest id take no part either. A length that the parts do not divide, or a
component beyond 32 bits after scaling, is an error. The first codebook comes from the rows in the order of id (null
ids last), then vector; a row that is repeated counts as often as it is there. With fewer rows than entries the codebooks
are as short as that. Other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import discard, staged
from .vectors import is_complete, lists, matrix, of_one_length, squared_distances, whole_numbers

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
SLICE = 4096
"""Rows compared with a codebook at once."""


@dataclass(frozen=True)
class Codes:
    rows: DataFrame
    """`id`, `label`, `numbers`, and per part the entry in `codes` and its squared distance in `errors`."""
    books: np.ndarray
    """Entries by part, index and position within the part."""


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every row, the lowest among equals, and its squared distance."""
    distances = squared_distances(parts, book)
    found = distances.argmin(axis=1)
    return found, distances[np.arange(len(parts)), found]


def reassigned(parts: np.ndarray, book: np.ndarray, moved: np.ndarray, codes: np.ndarray, errors: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries after some have moved, from the entries and distances before."""
    codes, errors = codes.copy(), errors.copy()
    active = np.flatnonzero(moved)
    if not len(active):
        return codes, errors
    lost = moved[codes]
    codes[lost], errors[lost] = nearest(parts[lost], book)
    kept = np.flatnonzero(~lost)
    rival, distance = nearest(parts[kept], book[active])
    rival = active[rival]
    closer = (distance < errors[kept]) | ((distance == errors[kept]) & (rival < codes[kept]))
    codes[kept[closer]], errors[kept[closer]] = rival[closer], distance[closer]
    return codes, errors


def _assign(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """Rows with `codes` and `errors`; without `moved` they have none yet and are compared with all entries."""
    parts, _, width = books.shape
    kept = ["id", "label", "numbers"]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("codes", T.ArrayType(T.IntegerType())),
                           T.StructField("errors", T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                piece = batch.slice(first, SLICE)
                column = lambda name: piece.column(piece.schema.get_field_index(name))  # noqa: B023, E731
                numbers = matrix(column("numbers"), parts * width)
                if moved is not None:
                    codes, errors = matrix(column("codes"), parts), matrix(column("errors"), parts)
                found = []
                for p in range(parts):
                    part = numbers[:, p * width:(p + 1) * width]
                    found.append(nearest(part, books[p]) if moved is None else
                                 reassigned(part, books[p], moved[p], codes[:, p], errors[:, p]))
                yield pa.RecordBatch.from_arrays(
                    [*[column(c) for c in kept], lists(np.stack([c for c, _ in found], 1), pa.int32()),
                     lists(np.stack([e for _, e in found], 1), pa.int64())], names=[*kept, "codes", "errors"])

    return rows.mapInArrow(run, schema)


def _sums(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and componentwise sum of the parts of every entry. A task sends one row per entry that it met."""
    parts, entries, width = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            codes = matrix(batch.column(0), parts)
            numbers = matrix(batch.column(1), parts * width)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], numbers[:, p * width:(p + 1) * width])
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]),
                 lists(sums[part, entry], pa.int64())], names=["part", "entry", "n", "sums"])

    met = rows.select("codes", "numbers").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    total = met.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[
        F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for r in total.collect():  # one row per entry at most
        counts[r["part"], r["entry"]], sums[r["part"], r["entry"]] = r["n"], r["sums"]
    return counts, sums


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codes | None:
    """Codes and codebooks after the given rounds and a last assignment; None where no row takes part."""
    spark = vectors.sparkSession
    whole = vectors.filter(is_complete(vectors[vector])).select(
        vectors[key].alias("id"), vectors[label].alias("label"), whole_numbers(vectors[vector], scale).alias("numbers"))
    order = [F.col("id").asc_nulls_last(), F.col("numbers")]
    first = whole.orderBy(*order).select("numbers").first()
    if first is None:
        return None
    length = len(first["numbers"])
    if length == 0 or length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    alike = of_one_length(whole, "numbers", length)
    start = np.array([r[0] for r in alike.orderBy(*order).limit(entries).select("numbers").collect()], np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, length // parts).transpose(1, 0, 2))
    rows, path = staged(_assign(alike, books, None))
    for _ in range(rounds):
        counts, sums = _sums(rows, books)
        means = np.where(counts[:, :, None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[:, :, None]), books)
        moved = (means != books).any(axis=2)
        if not moved.any():
            break  # every later round would repeat this one
        books, before = means, path
        rows, path = staged(_assign(rows, books, moved))
        discard(spark, before)
    return Codes(rows, books)


def code_string(codes: Column) -> Column:
    """Entries as two hex digits each, in part order."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def total_error(errors: Column) -> Column:
    return F.aggregate(errors, F.lit(0).cast("bigint"), lambda total, e: total + e)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds the sum of `error` over the rows with an equal label, nulls together.

    Counted per task before the shuffle. The join has a second key, so that both sides are dealt anew and adaptive execution
    can split a label that a third of all rows share: the other side has one row for it.
    """
    keyed = lambda df: df.withColumn("_label", F.xxhash64("label"))
    sums = keyed(rows.groupBy("label").agg(F.sum("error").alias("label_error"))).select(
        F.col("label").alias("_of"), F.col("_label").alias("_again"), "label_error")
    return keyed(rows).join(sums, F.col("label").eqNullSafe(F.col("_of")) & (F.col("_label") == F.col("_again")), "left") \
        .drop("_of", "_again", "_label")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of the decimal components of all entries by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
