"""Row validation: every error of a row is listed, and rows with errors are set apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import ENVELOPE_FIELDS, FieldMapping, TableContract, TargetContract
from ..functions.text import plain_text
from .projection import ERRORS, compact, project
from .skew import spread_join
from .union import union_all


# Error texts.
MISSING = "required target field '{}' is missing or null"
NOT_ALLOWED = "' is not a valid value for enum '{}'"
NO_TABLE = "target table '{}' not found in target schema"


def column_errors(table: TableContract, schema: T.StructType, value=F.col, supplied=None) -> list[Column]:
    """Required and enum checks of one table; `value` turns a column name into its column.

    `supplied` tells whether a row supplies a column at all; one that is not supplied is not missing.
    """
    found = {f.name: f.dataType for f in schema.fields}
    errors = []
    for column in table.columns:
        if column.name in ENVELOPE_FIELDS:
            continue
        present = column.name in found
        c = value(column.name) if present else F.lit(None)
        if not column.nullable:
            missing = c.isNull()
            if present and isinstance(found[column.name], T.StringType):
                missing = missing | (c == "")
            if present and supplied is not None:
                missing = missing & supplied(column.name)
            errors.append(F.when(missing, F.lit(MISSING.format(column.name))))
        if column.enum_values and present:
            shown = plain_text(c, found[column.name])
            text = F.concat(F.lit("'"), shown, F.lit(NOT_ALLOWED.format(column.name)))
            errors.append(F.when(~shown.isin(*column.enum_values), text))
    return errors


def transform_rows(
    df: DataFrame, mappings: Sequence[FieldMapping], contract: TargetContract,
    keep: Sequence[str] = (), as_of: Column | None = None,
) -> DataFrame:
    """Projection plus checks against every table the mappings name."""
    rows = project(df, mappings, keep, as_of)
    checks: list[Column] = []
    for name in dict.fromkeys(m.target_table for m in mappings if m.target_table and m.target_column):
        table = contract.table(name)
        if table is None:
            checks.append(F.lit(NO_TABLE.format(name)))
        else:
            checks += column_errors(table, rows.schema)
    return rows.withColumn(ERRORS, F.concat(ERRORS, compact(checks)))


def check_staged(staged: DataFrame, contract: TargetContract, supplied=None) -> DataFrame:
    """Adds the checks of every staged table to the error list, columns the writer fills excepted.

    `supplied` (table, column) tells whether a row supplies a column; by default all mapped ones are.
    """
    checks: list[Column] = []
    for field in staged.schema.fields:
        table = contract.table(field.name)
        if table is None or not isinstance(field.dataType, T.StructType):
            continue
        filled = table.managed_columns | {c.name for c in table.columns if c.primary_key}
        checked = TableContract(table.name, tuple(c for c in table.columns if c.name not in filled))
        sent = None if supplied is None else lambda n, t=field.name: supplied(t, n)
        checks += column_errors(checked, field.dataType, lambda n, t=field.name: F.col(f"{t}.{n}"), sent)
    return staged.withColumn(ERRORS, F.concat(ERRORS, compact(checks)))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows); together they are exactly the input."""
    clean = F.size(ERRORS) == 0
    return rows.filter(clean).drop(ERRORS), rows.filter(~clean)


def unknown_columns(mapping: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mapped target columns the catalog does not have."""
    return mapping.join(
        catalog.select(F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column")),
        ["target_table", "target_column"], "left_anti")


def quarantine_upsert(quarantine: DataFrame, failed: DataFrame) -> DataFrame:
    """New quarantine content: an event already there gets the new errors and keeps its payload."""
    incoming = failed.groupBy("event_id").agg(
        F.array_distinct(F.flatten(F.array_sort(F.collect_list("errors")))).alias("new_errors"),
        F.min("payload_snapshot").alias("new_payload"))
    return quarantine.join(incoming, "event_id", "full_outer").select(
        "event_id",
        F.coalesce("new_errors", "errors").alias("errors"),
        F.coalesce("payload_snapshot", "new_payload").alias("payload_snapshot"),
    )


def mark_quarantined(outbox: DataFrame, failed: DataFrame, as_of: Column) -> DataFrame:
    """Outbox after quarantine: status, error code and the errors joined into one message."""
    every = F.array_distinct(F.flatten(F.array_sort(F.collect_list("errors"))))
    hits = failed.groupBy("event_id").agg(F.array_join(every, "; ").alias("_message"))
    hit = F.col("_message").isNotNull()
    return outbox.join(hits, "event_id", "left").withColumns({
        "status": F.when(hit, "quarantined").otherwise(F.col("status")),
        "processed_at": F.when(hit, as_of).otherwise(F.col("processed_at")),
        "last_error_code": F.when(hit, "VALIDATION").otherwise(F.col("last_error_code")),
        "last_error_message": F.coalesce("_message", "last_error_message"),
    }).drop("_message")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose foreign key names no parent row; null keys are not orphans."""
    linked = child.filter(F.col(column).isNotNull())
    return spread_join(linked, parent.select(F.col(key).alias(column)), column, "left_anti", linked.columns)


def referential_report(links: Sequence[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """Orphan count per declared foreign key.

    Children are counted per key value before the join, so one hot key is one row of the shuffle.
    """
    report = []
    for child_name, child, column, parent_name, parent, key in links:
        counted = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).count()
        lost = counted.join(parent.select(F.col(key).alias("_k")), "_k", "left_anti")
        report.append(lost.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("orphans"),
                       F.count("*").alias("missing_keys")).select(
            F.lit(f"{child_name}.{column}").alias("child"), F.lit(f"{parent_name}.{key}").alias("parent"),
            "orphans", "missing_keys"))
    return union_all(*report)
