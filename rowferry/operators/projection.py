"""Mapped projection: source columns to target columns, one row to several tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import ContractError, FieldMapping, TableContract, TargetContract
from ..functions import coercion, transforms
from ..functions.coercion import SPARK_TYPES

ERRORS = "errors"
AUDIT_TIMES = ("source_updated_at", "accepted_at")


def usable(mappings: Iterable[FieldMapping], columns: Sequence[str]) -> list[FieldMapping]:
    """Mappings that have a target and an existing source; the last one per target column wins."""
    chosen: dict[tuple[str, str], FieldMapping] = {}
    for m in mappings:
        if m.target_table and m.target_column and m.source_column in columns:
            chosen[(m.target_table, m.target_column)] = m
    return list(chosen.values())


def without_managed(mappings: Iterable[FieldMapping], contract: TargetContract) -> list[FieldMapping]:
    """Drops mappings onto generated keys and foreign keys, which the writer fills itself."""
    kept = []
    for m in mappings:
        table = contract.table(m.target_table) if m.target_table else None
        if table is None or m.target_column not in table.managed_columns:
            kept.append(m)
    return kept


def mapped_value(
    df: DataFrame, mapping: FieldMapping, as_of: Column | None = None
) -> tuple[Column, Column | None]:
    """Value and failure text of one mapping."""
    dtype = df.schema[mapping.source_column].dataType
    source = F.col(f"`{mapping.source_column}`")
    if mapping.target_column in AUDIT_TIMES and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        source = transforms.default_timestamp(source, as_of)
    return transforms.apply(mapping.transform, source, dtype)


def compact(errors: Sequence[Column]) -> Column:
    """Array of the error texts that are not null."""
    if not errors:
        return F.array().cast("array<string>")
    return F.filter(F.array(*errors), lambda e: e.isNotNull())


def project(
    df: DataFrame, mappings: Sequence[FieldMapping], keep: Sequence[str] = (), as_of: Column | None = None
) -> DataFrame:
    """Flat projection: kept source columns, mapped target columns and the list of errors."""
    values, errors = [], []
    for m in usable(mappings, df.columns):
        value, failure = mapped_value(df, m, as_of)
        values.append(value.alias(m.target_column))
        if failure is not None:
            prefix = f"transform failed for {m.source_column} -> {m.target_column}: "
            errors.append(F.concat(F.lit(prefix), failure))
    return df.select(*[F.col(k) for k in keep], *values, compact(errors).alias(ERRORS))


def stage(
    df: DataFrame, mappings: Sequence[FieldMapping], contract: TargetContract,
    keep: Sequence[str] = (), as_of: Column | None = None,
) -> DataFrame:
    """One struct column per target table, widths applied, plus the list of errors.

    The struct keeps the fan-out to one pass over the source; `fan_out` picks a table from it.
    """
    by_table: dict[str, list[Column]] = {}
    errors: list[Column] = []
    for m in usable(without_managed(mappings, contract), df.columns):
        value, failure = mapped_value(df, m, as_of)
        table = contract.table(m.target_table)
        column = table.column(m.target_column) if table else None
        if column is not None and column.width is not None:
            value = transforms.cut_to_width(value, column.width)
        by_table.setdefault(m.target_table, []).append(value.alias(m.target_column))
        if failure is not None:
            prefix = f"transform failed for {m.source_column} -> {m.target_table}.{m.target_column}: "
            errors.append(F.concat(F.lit(prefix), failure))
    if not by_table:
        raise ContractError("mapping produced no target values")
    structs = [F.struct(*cols).alias(table) for table, cols in by_table.items()]
    return df.select(*[F.col(k) for k in keep], *structs, compact(errors).alias(ERRORS))


def fan_out(staged: DataFrame, table: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of one target table."""
    return staged.select(*[F.col(k) for k in keep], F.col(f"{table}.*"))


def truncated_counts(df: DataFrame, mappings: Sequence[FieldMapping], contract: TargetContract) -> DataFrame:
    """How many values each width-bounded target column has to cut."""
    columns = []
    for m in usable(without_managed(mappings, contract), df.columns):
        table = contract.table(m.target_table)
        column = table.column(m.target_column) if table else None
        if column is not None and column.width is not None:
            value, _ = mapped_value(df, m)
            columns.append((f"{m.target_table}.{m.target_column}", F.count_if(F.length(value) > column.width)))
    totals = df.agg(*[c.alias(name) for name, c in columns])
    pairs = F.array(*[F.struct(F.lit(n).alias("target_column"), F.col(f"`{n}`").alias("truncated"))
                      for n, _ in columns])
    return totals.select(F.inline(pairs))


def coerce_rows(df: DataFrame, table: TableContract, engine: str | None = None) -> DataFrame:
    """Casts every column of a contract toward its generic type; `uncoerced` lists what did not fit."""
    types = {**coercion_types(engine)}
    values, failed = [], []
    for name in df.columns:
        column = table.column(name)
        if column is None:
            values.append(F.col(name))
            continue
        generic = types.get(column.data_type.split("(")[0].strip().lower(), "string")
        result = coercion.coerce(F.col(name), df.schema[name].dataType, generic)
        values.append(result.value.alias(name))
        failed.append(F.when(result.uncoerced, F.lit(name)))
    return df.select(*values, compact(failed).alias("uncoerced"))


def coercion_types(engine: str | None) -> dict[str, str]:
    """Native base name to generic type; both engines when none is named, the second one first."""
    if engine is None:
        return {**coercion.MYSQL_TYPES, **coercion.POSTGRES_TYPES}
    known = coercion.ENGINES[engine.strip().lower()]
    return coercion.MYSQL_TYPES if known == "mysql" else coercion.POSTGRES_TYPES


def serialise_nested(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps become JSON text; other columns stay."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[
        F.to_json(F.col(f.name), {"ignoreNullFields": "false"}).alias(f.name)
        if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields
    ])


def redact(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Drops the named fields at every depth of structs, arrays and maps."""
    hidden = frozenset(keys)

    def clean(c: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StructType):
            kept = [clean(c[f.name], f.dataType).alias(f.name) for f in dtype.fields if f.name not in hidden]
            return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None).cast("string")
        if isinstance(dtype, T.ArrayType):
            return F.transform(c, lambda item: clean(item, dtype.elementType))
        if isinstance(dtype, T.MapType):
            kept = F.map_filter(c, lambda k, v: ~k.isin(*hidden)) if hidden else c
            return F.transform_values(kept, lambda k, v: clean(v, dtype.valueType))
        return c

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name)
                       for f in df.schema.fields if f.name not in hidden])


def empty_target(spark, table: TableContract, engine: str | None = None) -> DataFrame:
    """Empty frame with the columns a contract declares, as typed as Spark can."""
    types = coercion_types(engine)
    fields = [
        T.StructField(c.name, SPARK_TYPES[types.get(c.data_type.split("(")[0].strip().lower(), "string")],
                      c.nullable, {"primary_key": c.primary_key, "native_type": c.data_type})
        for c in table.columns
    ]
    return spark.createDataFrame([], T.StructType(fields))
