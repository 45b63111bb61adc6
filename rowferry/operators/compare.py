"""Source and target side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_text


def _texts(df: DataFrame, fields: Sequence[str], key: str, name: str) -> DataFrame:
    values = [plain_text(F.col(f), df.schema[f].dataType).alias(f) for f in fields]
    return df.select(F.col(key), F.struct(*values).alias(name))


def compare_fields(
    source: DataFrame, crosswalk: DataFrame, target: DataFrame, pk: str, fields: Sequence[str]
) -> DataFrame:
    """One row per source row and field: both values as text, and whether they agree.

    `source` is keyed by external_reference and already carries target column names. Rows known on one
    side only are kept and flagged.
    """
    left = _texts(source, fields, "external_reference", "_source")
    right = _texts(target, fields, pk, "_target").withColumn("target_id", F.col(pk).cast("string"))
    owned = crosswalk.select("external_reference", F.col("target_id").cast("string").alias("target_id"))
    joined = left.join(owned, "external_reference", "full_outer") \
        .join(right.select("target_id", "_target"), "target_id", "left")
    compared = F.col("_target").isNotNull()
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_source.{f}").alias("source"),
                               F.col(f"_target.{f}").alias("target")) for f in fields])
    return joined.select(
        "external_reference", "target_id", F.col("_source").isNull().alias("missing_in_source"),
        (F.col("_source").isNotNull() & F.col("target_id").isNull()).alias("missing_in_target"),
        compared.alias("compared"), F.inline(pairs),
    ).withColumn("matches", F.col("compared") & F.col("source").eqNullSafe(F.col("target")))


def mismatch_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("field").agg(
        F.count("*").alias("rows"), F.count_if("matches").alias("matching"),
        F.count_if(F.col("compared") & ~F.col("matches")).alias("differing"),
        F.count_if("missing_in_target").alias("missing_in_target"),
        F.count_if("missing_in_source").alias("missing_in_source"))


def flatten(
    tables: dict[str, DataFrame], base: str, edges: Sequence[tuple[str, str, str, str]],
    columns: Sequence[tuple[str, str]],
) -> DataFrame:
    """Left-joins a base table along (from, from column, to, to column) edges and picks columns.

    A repeated column name gets its table as prefix, and then a number.
    """
    prefixed = {t: df.select(*[F.col(c).alias(f"{t}${c}") for c in df.columns]) for t, df in tables.items()}
    joined, done = prefixed[base], {base}
    for from_table, from_column, to_table, to_column in edges:
        if to_table in done:
            continue
        if from_table not in done:
            raise ValueError(f"{from_table} must be joined before {to_table}")
        on = F.col(f"{from_table}${from_column}") == F.col(f"{to_table}${to_column}")
        joined = joined.join(prefixed[to_table], on, "left")
        done.add(to_table)
    names: list[str] = []
    for table, column in columns:
        name = column if column not in names else f"{table}_{column}"
        number, chosen = 2, name
        while chosen in names:
            chosen, number = f"{name}_{number}", number + 1
        names.append(chosen)
    return joined.select(*[F.col(f"{t}${c}").alias(n) for (t, c), n in zip(columns, names, strict=True)])
