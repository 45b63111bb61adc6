"""Keyed merges of a current snapshot with a batch; each returns the next snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import checksum, row_json
from .ordering import first_per_key
from .union import union_all


def upsert_newer(
    current: DataFrame, batch: DataFrame, keys: Sequence[str], time: str, arrival: Sequence[str] = (),
    small_batch: bool = False,
) -> DataFrame:
    """Insert or update by key where an older row never replaces a newer one.

    Equal times take the incoming row; among incoming rows of equal time the last arrival wins. One
    shuffle brings both sides together. With `small_batch` only the rows the batch names are compared:
    while the batch stays below the broadcast limit, the snapshot is then not shuffled at all.
    """
    columns = [*current.columns, *[a for a in arrival if a not in current.columns]]
    order = [F.col(time).desc_nulls_last(), F.col("_incoming").desc(), *[F.col(a).desc_nulls_last() for a in arrival]]

    def newest(old: DataFrame, new: DataFrame) -> DataFrame:
        missing = [F.lit(None).cast(batch.schema[a].dataType).alias(a) for a in arrival if a not in old.columns]
        rivals = union_all(old.select("*", *missing, F.lit(0).alias("_incoming")),
                           new.select(*columns, F.lit(1).alias("_incoming")))
        return first_per_key(rivals, keys, order).select(*current.columns)

    if not small_batch:
        return newest(current, batch)
    named = batch.select(*keys).distinct()
    return union_all(current.join(named, list(keys), "left_anti"),
                     newest(current.join(named, list(keys), "left_semi"), batch))


def upsert_last(
    current: DataFrame, batch: DataFrame, keys: Sequence[str], arrival: Sequence[str] = (),
) -> DataFrame:
    """Insert or update by key, the last arrival wins; a row made of keys only never updates.

    Without an arrival order the greatest of the rows that share a key is taken, so one row per key is left.
    """
    rest = [F.col(c).desc_nulls_last() for c in current.columns if c not in keys]
    order = [F.col(a).desc_nulls_last() for a in arrival] + rest or [F.col(k) for k in keys]
    incoming = first_per_key(batch, keys, order).select(*current.columns)
    if set(current.columns) <= set(keys):
        return insert_absent(current, incoming, keys)
    return union_all(current.join(incoming.select(*keys), list(keys), "left_anti"), incoming)


def insert_absent(current: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds only rows whose key is not there yet; the first of equal keys in the batch is used."""
    fresh = batch.select(*current.columns).join(current.select(*keys), list(keys), "left_anti")
    rest = [c for c in current.columns if c not in keys]
    return union_all(current, first_per_key(fresh, keys, [F.col(c) for c in rest or keys]))


def unseen(rows: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(seen.select(*keys), list(keys), "left_anti")


def backfill_events(rows: DataFrame, seen: DataFrame, entity: str, target_system: str, payload: Sequence[str], as_of: Column
                    ) -> DataFrame:
    """Pending outbox events, with payload and checksum, for the rows of an entity that have had none.

    `seen` is (source_entity, external_reference) of the events so far.
    """
    mine = seen.filter(F.col("source_entity") == entity)
    fresh = unseen(rows, mine, ["external_reference"])
    document = row_json(fresh, [*payload, "external_reference"])
    return fresh.select(
        "external_reference", F.lit(entity).alias("source_entity"), F.lit(target_system).alias("target_system"),
        F.lit("backfill").alias("operation"), document.alias("payload"), checksum(document).alias("payload_checksum"),
        F.lit("pending").alias("status"), F.lit(0).alias("attempts"), as_of.alias("available_at"), as_of.alias("created_at"))


def scoped_delete(
    tables: Mapping[str, tuple[DataFrame, str]], crosswalk: DataFrame, entity: str, system: str,
    lookups: Sequence[str] = (),
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Deletes the rows an entity wrote, as its crosswalk records them.

    Returns the remaining tables, the remaining crosswalk and the number of deleted rows per table.
    Lookup tables and crosswalk rows of unknown tables stay.
    """
    written = [t for t in tables if t not in lookups]
    owned = (F.col("source_entity") == entity) & (F.col("target_system") == system) \
        & F.col("target_table").isin(*written)
    left: dict[str, DataFrame] = {}
    counts = []
    for name, (rows, pk) in tables.items():
        if name in lookups:
            left[name] = rows
            continue
        mine = crosswalk.filter(owned & (F.col("target_table") == name) & F.col("target_id").isNotNull()) \
            .select(F.col("target_id").try_cast(rows.schema[pk].dataType).alias(pk)).distinct()
        left[name] = rows.join(mine, pk, "left_anti")
        counts.append(rows.select(pk).join(mine, pk, "left_semi").agg(F.count("*").alias("deleted"))
                      .select(F.lit(name).alias("target_table"), "deleted"))
    if not counts:
        none = crosswalk.sparkSession.createDataFrame([], "target_table string, deleted bigint")
        return left, crosswalk, none
    return left, crosswalk.filter(~owned), union_all(*counts)


def split_sets(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key once with its side: added, removed or common."""
    old = left.select(*keys).distinct().withColumn("_old", F.lit(True))
    new = right.select(*keys).distinct().withColumn("_new", F.lit(True))
    side = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("common")
    return old.join(new, list(keys), "full_outer").select(*keys, side.alias("side"))


def snapshot_changes(
    before: DataFrame, after: DataFrame, keys: Sequence[str], deactivated_at: Column,
) -> DataFrame:
    """Change events between two snapshots; a vanished row becomes a deactivation, never a delete.

    The payload is the row as canonical JSON; a deactivation adds active and deactivated_at.
    """
    old = before.select(*keys, row_json(before).alias("_old"))
    new = after.select(*keys, row_json(after).alias("_new"))
    operation = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "deactivate") \
        .when(F.col("_old") != F.col("_new"), "update")
    closing = F.concat(F.lit(',"active":false,"deactivated_at":"'), deactivated_at.cast("string"), F.lit('"}'))
    gone = F.concat(F.expr("left(_old, length(_old) - 1)"), closing)
    changed = old.join(new, list(keys), "full_outer").withColumn("operation", operation) \
        .filter(F.col("operation").isNotNull()) \
        .withColumn("payload", F.when(F.col("operation") == "deactivate", gone).otherwise(F.col("_new")))
    return changed.select(*keys, "operation", "payload", checksum(F.col("payload")).alias("payload_checksum"))


def soft_delete(envelope: DataFrame, operation: str = "operation") -> DataFrame:
    """A deactivation only clears `active`; rows are never removed."""
    return envelope.withColumn("active", F.col(operation) != "deactivate")
