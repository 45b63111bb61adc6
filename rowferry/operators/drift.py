"""Comparing contracts that are themselves data.

A catalog frame has one row per column: table_name, position, column_name, data_type, nullable,
is_primary_key. A table holds as many columns as its engine allows (a few thousand), which bounds
every per-table list below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import checksum, json_value
from .union import union_all

_TEXT = T.StringType()


def _column_json() -> Column:
    def text(name: str) -> Column:
        return json_value(F.col(name), _TEXT)

    # Fixed format: the document a contract is hashed as, keys sorted, without blanks.
    return F.concat(
        F.lit('{"data_type":'), text("data_type"),
        F.lit(',"description":"","enum_values":null,"is_foreign_key":false,"is_primary_key":'),
        F.col("is_primary_key").cast("string"), F.lit(',"name":'), text("column_name"),
        F.lit(',"nullable":'), F.col("nullable").cast("string"), F.lit(',"references":null,"sample_values":[]}'))


def table_documents(catalog: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """JSON text of every table, its columns in order."""
    columns = F.sort_array(F.collect_list(F.struct("position", _column_json().alias("json"))))
    grouped = catalog.groupBy(*scope, "table_name").agg(columns.alias("_columns"))
    body = F.array_join(F.transform("_columns", lambda c: c["json"]), ",")
    return grouped.select(*scope, "table_name", F.concat(
        F.lit('{"columns":['), body, F.lit('],"name":'), json_value(F.col("table_name"), _TEXT), F.lit("}")
    ).alias("document"))


def _schema_hash(system: str, tables: Column) -> Column:
    head = F.concat(F.lit('{"system_name":'), json_value(F.lit(system), _TEXT), F.lit(',"tables":['))
    return checksum(F.concat(head, tables, F.lit('],"version":"1"}')))


def table_fingerprints(catalog: DataFrame, system: str) -> DataFrame:
    """Fingerprint of every table as a contract of its own."""
    return table_documents(catalog).select(
        "table_name", _schema_hash(system, F.col("document")).alias("fingerprint"))


def entity_fingerprints(catalog: DataFrame, footprints: DataFrame, system: str) -> DataFrame:
    """Fingerprint over exactly the tables of each entity; entities without a live table have none.

    `footprints` is (source_entity, table_name). Documents are built once per table and then shared.
    """
    used = footprints.join(table_documents(catalog), "table_name")
    listed = used.groupBy("source_entity").agg(
        F.sort_array(F.collect_list(F.struct("table_name", "document"))).alias("_tables"))
    body = F.array_join(F.transform("_tables", lambda t: t["document"]), ",")
    return listed.select("source_entity", _schema_hash(system, body).alias("fingerprint"))


def contract_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two catalogs with a breaking flag, one row each.

    Breaking: a table or column is gone, a type or key flag changed, a column became or came required.
    """
    attributes = ("data_type", "nullable", "is_primary_key")
    no_changes = F.array().cast("array<struct<attribute:string,before:string,after:string>>")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("table_name", "column_name", F.struct(*attributes).alias(name))

    both = side(before, "old").join(side(after, "new"), ["table_name", "column_name"], "full_outer")
    tables = both.groupBy("table_name").agg(
        F.bool_or(F.col("old").isNotNull()).alias("_had"), F.bool_or(F.col("new").isNotNull()).alias("_has"),
        F.collect_list(F.when(~F.col("old").eqNullSafe(F.col("new")), F.struct("column_name", "old", "new")))
        .alias("_columns"))

    def judge(c: Column) -> Column:
        old, new = c["old"], c["new"]
        changes = F.filter(F.array(*[
            F.when(old[a] != new[a], F.struct(F.lit(a).alias("attribute"), old[a].cast("string").alias("before"),
                                              new[a].cast("string").alias("after")))
            for a in attributes]), lambda change: change.isNotNull())
        broken = (old["data_type"] != new["data_type"]) | (old["is_primary_key"] != new["is_primary_key"]) \
            | (old["nullable"] & ~new["nullable"])
        kind = F.when(old.isNull(), "column_added").when(new.isNull(), "column_removed").otherwise("column_changed")
        return F.struct(
            c["column_name"].alias("column_name"), kind.alias("kind"),
            F.when(old.isNull(), ~new["nullable"]).when(new.isNull(), True).otherwise(broken).alias("breaking"),
            F.when(old.isNull() | new.isNull(), no_changes).otherwise(changes).alias("changes"))

    whole = F.array(F.struct(
        F.lit(None).cast("string").alias("column_name"),
        F.when(F.col("_had"), "table_removed").otherwise("table_added").alias("kind"),
        F.col("_had").alias("breaking"), no_changes.alias("changes")))
    listed = F.when(F.col("_had") & F.col("_has"), F.transform("_columns", judge)).otherwise(whole)
    return tables.select("table_name", F.inline(listed))


def structural_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per touched table: its state and the sorted added, removed and changed columns."""
    old = before.select("table_name", "column_name", F.struct("data_type", "nullable").alias("old"))
    new = after.select("table_name", "column_name", F.struct("data_type", "nullable").alias("new"))
    both = old.join(new, ["table_name", "column_name"], "full_outer")

    def names(condition: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, F.col("column_name"))))

    there = F.col("old").isNotNull() & F.col("new").isNotNull()
    grouped = both.groupBy("table_name").agg(
        F.bool_or(F.col("old").isNotNull()).alias("_had"), F.bool_or(F.col("new").isNotNull()).alias("_has"),
        names(F.col("old").isNull()).alias("added_columns"), names(F.col("new").isNull()).alias("removed_columns"),
        names(there & (F.col("old") != F.col("new"))).alias("changed_columns"))
    state = F.when(~F.col("_had"), "added").when(~F.col("_has"), "removed").otherwise("changed")
    touched = (~F.col("_had") | ~F.col("_has") | (F.size("added_columns") > 0)
               | (F.size("removed_columns") > 0) | (F.size("changed_columns") > 0))
    whole = F.col("state") == "changed"
    none = F.array().cast("array<string>")
    return grouped.filter(touched).withColumn("state", state).select(
        "table_name", "state", *[F.when(whole, F.col(c)).otherwise(none).alias(c)
                                 for c in ("added_columns", "removed_columns", "changed_columns")])


def source_changes(entities: DataFrame, documents: DataFrame, approved: DataFrame, live: DataFrame) -> DataFrame:
    """Per entity: what its source table lost, gained or retyped against its approved contract.

    `entities` is (source_entity); `documents` are captured contract columns and `approved` the accepted
    column names, both by source_entity. Without a document the names borrow their live types, so only
    presence counts. Additions alone do not affect an entity.
    """
    documented = documents.select("source_entity").distinct().withColumn("_doc", F.lit(True))
    full = documents.select("source_entity", "column_name", "data_type", "nullable", F.lit(False).alias("_names"))
    names = approved.join(documented, "source_entity", "left_anti").select(
        "source_entity", "column_name", F.lit(None).cast("string").alias("data_type"),
        F.lit(None).cast("boolean").alias("nullable"), F.lit(True).alias("_names"))
    old = union_all(full, names).withColumn("_old", F.lit(True))
    now = live.select(F.col("table_name").alias("source_entity"), "column_name", F.col("data_type").alias("_type"),
                      F.col("nullable").alias("_nullable"), F.lit(True).alias("_new"))
    now = now.join(entities.select("source_entity"), "source_entity", "left_semi")
    both = old.join(now, ["source_entity", "column_name"], "full_outer")
    there = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    retyped = there & ~F.col("_names") & (
        ~F.col("data_type").eqNullSafe(F.col("_type")) | ~F.col("nullable").eqNullSafe(F.col("_nullable")))

    def listed(condition: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, F.col("column_name"))))

    grouped = both.groupBy("source_entity").agg(
        F.bool_or(F.col("_new").isNotNull()).alias("_live"),
        listed(F.col("_old").isNull()).alias("_added"), listed(F.col("_new").isNull()).alias("_removed"),
        listed(retyped).alias("_changed"))
    none = F.array().cast("array<string>")
    report = entities.select("source_entity").join(grouped, "source_entity", "left") \
        .join(documented, "source_entity", "left").select(
        "source_entity", (~F.coalesce("_live", F.lit(False))).alias("missing_table"),
        F.coalesce("_added", none).alias("added_columns"), F.coalesce("_removed", none).alias("removed_columns"),
        F.coalesce("_changed", none).alias("changed_columns"),
        F.when(F.col("_doc"), "document").otherwise("approved_columns").alias("contract_source"))
    return report.withColumn("affected", F.col("missing_table") | (F.size("removed_columns") > 0)
                             | (F.size("changed_columns") > 0))


def affected_entities(footprints: DataFrame, changed: DataFrame) -> DataFrame:
    """Entities one of whose target tables changed, with the sorted list of those tables."""
    return footprints.join(changed.select("table_name").distinct(), "table_name", "left_semi") \
        .groupBy("source_entity").agg(F.sort_array(F.collect_set("table_name")).alias("affected_tables"))


def impacted_by_breaking(changes: DataFrame, footprints: DataFrame) -> DataFrame:
    return affected_entities(footprints, changes.filter("breaking")).select("source_entity")


def drift_report(changes: DataFrame, impacted: DataFrame, pair: str, fingerprint: Column, as_of: Column) -> DataFrame:
    """One row: what differs between two contracts, whether any of it breaks, and which entities it stops.

    A contract's columns are few; the differences of one comparison make one row.
    """
    change = F.struct("table_name", "column_name", "kind", "breaking")
    found = changes.agg(F.array_sort(F.collect_list(change)).alias("differences"),
                        F.coalesce(F.bool_or("breaking"), F.lit(False)).alias("breaking"))
    stopped = impacted.agg(F.array_sort(F.collect_set("source_entity")).alias("impacted_entities"))
    # Both sides are one row of an aggregate without keys.
    return found.withColumn("_one", F.lit(1)).join(stopped.withColumn("_one", F.lit(1)), "_one").select(
        F.lit(pair).alias("drift_pair"), fingerprint.alias("fingerprint"), "differences", "impacted_entities", "breaking",
        as_of.alias("detected_at"))


def pause_entities(control: DataFrame, mappings: DataFrame, impacted: DataFrame, fingerprint: Column
                   ) -> tuple[DataFrame, DataFrame]:
    """Disables impacted entities and pauses their approved mappings; everything else stays."""
    hit = impacted.select("source_entity").distinct().withColumn("_hit", F.lit(True))
    reason = F.concat(F.lit("Breaking schema drift "), F.left(fingerprint, F.lit(12)))
    paused = control.join(hit, "source_entity", "left").withColumns({
        "enabled": F.when(F.col("_hit"), False).otherwise(F.col("enabled")),
        "paused_reason": F.when(F.col("_hit"), reason).otherwise(F.col("paused_reason")),
    }).drop("_hit")
    held = mappings.join(hit, "source_entity", "left").withColumn(
        "status", F.when(F.col("_hit") & (F.col("status") == "approved"), "paused").otherwise(F.col("status"))
    ).drop("_hit")
    return paused, held


def monitor(entities: DataFrame, source_now: DataFrame, target_now: DataFrame) -> DataFrame:
    """Stored against recomputed fingerprints. Entities of the old fingerprint scope are exempt."""
    current = entities.join(source_now.select("source_entity", F.col("fingerprint").alias("_source")),
                            "source_entity", "left") \
        .join(target_now.select("source_entity", F.col("fingerprint").alias("_target")), "source_entity", "left")
    legacy = F.coalesce("scope_version", F.lit(1)) < 2

    def drifted(stored: str, now: str) -> Column:
        known = F.coalesce(F.col(stored), F.lit("")) != ""
        return ~legacy & known & ~F.col(stored).eqNullSafe(F.col(now))

    return current.withColumns({
        "source_drift": drifted("source_fingerprint", "_source"),
        "target_drift": drifted("target_fingerprint", "_target"),
    }).select("source_entity", "source_drift", "target_drift",
              (F.col("source_drift") | F.col("target_drift")).alias("paused"), legacy.alias("rebaseline_required"))


def file_drift(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Compares file hashes with stored ones. `files` is (path, sha256), `stored` is (path, fingerprint)."""
    state = F.when(F.col("fingerprint").isNull(), "unversioned").when(F.col("sha256").isNull(), "missing") \
        .when(F.col("fingerprint") != F.col("sha256"), "drifted").otherwise("match")
    return files.join(stored, "path", "full_outer").select("path", "sha256", "fingerprint", state.alias("state"))
