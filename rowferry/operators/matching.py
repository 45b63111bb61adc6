"""Proposing mappings from names, and judging proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import ENVELOPE_FIELDS
from ..functions.text import name_key, substrings
from .ordering import first_per_key, top_per_group
from .union import union_all

# Confidence limits and name scores.
ACCEPT_AT = 0.95
EXACT_COLUMN, PARTIAL_COLUMN = 0.6, 0.5
EXACT_TABLE, PARTIAL_TABLE, PART_TABLE = 1.0, 0.7, 0.4
CANDIDATES = 5


def match_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """Best target column per source column by name: equal, else one containing the other.

    `source` is (source_table, source_column), `target` is (position, target_table, target_column);
    the first target in order wins. Containment is an equality join on substrings, and every
    substring keeps its first target only, so common fragments do not multiply.
    """
    wanted = source.withColumn("_name", name_key(F.col("source_column")))
    first = F.min(F.struct("position", "target_table", "target_column")).alias("_hit")
    names = target.withColumn("_name", name_key(F.col("target_column"))).groupBy("_name").agg(first)
    inside = names.select(F.explode(substrings(F.col("_name"))).alias("_name"), "_hit") \
        .groupBy("_name").agg(F.min("_hit").alias("_hit"))
    asked = wanted.select("_name").distinct()
    exact = asked.join(names, "_name").select("_name", F.lit(0).alias("_kind"), "_hit")
    within = asked.join(inside, "_name").select("_name", F.lit(1).alias("_kind"), "_hit")
    around = asked.select(F.col("_name").alias("_asked"), F.explode(substrings(F.col("_name"))).alias("_name")) \
        .join(names, "_name").select(F.col("_asked").alias("_name"), F.lit(1).alias("_kind"), "_hit")
    best = union_all(exact, within, around).groupBy("_name").agg(
        F.min(F.struct("_kind", "_hit")).alias("_best"))
    score = F.when(F.col("_best._kind") == 0, EXACT_COLUMN).when(F.col("_best._kind") == 1, PARTIAL_COLUMN) \
        .otherwise(0.0)
    return wanted.join(best, "_name", "left").select(
        "source_table", "source_column", F.col("_best._hit.target_table").alias("target_table"),
        F.col("_best._hit.target_column").alias("target_column"), score.alias("confidence"))


def rank_tables(source: DataFrame, target: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k most similar target tables of every source table.

    `source` is (source_table), `target` is (position, target_table). Equal names score 1.0, containment
    0.7, a shared name part 0.4, anything else 0; order breaks ties. Per name fragment only the first
    2 * k targets can still reach the result (fewer than k places may go to a better score), so the
    rest is dropped before any join: the result stays exact and no fragment fans out.
    """
    depth = 2 * k
    names = target.select("position", "target_table", F.lower("target_table").alias("_name"))
    asked = source.select("source_table", F.lower("source_table").alias("_asked"))

    def leading(df: DataFrame, key: str) -> DataFrame:
        return first_per_key(df, [key], [F.col("position")], depth)

    whole = leading(names, "_name")
    pieces = leading(names.select("position", "target_table", F.explode(substrings(F.col("_name"))).alias("_piece")),
                     "_piece")
    asks = asked.select("_asked").distinct()

    def scored(df: DataFrame, score: float) -> DataFrame:
        return df.select("_asked", "target_table", "position", F.lit(score).alias("score"))

    exact = asks.join(whole, asks["_asked"] == whole["_name"])
    within = asks.join(pieces, asks["_asked"] == pieces["_piece"])
    around = asks.select("_asked", F.explode(substrings(F.col("_asked"))).alias("_name")).join(whole, "_name")
    parts = asks.select("_asked", F.explode(F.array_distinct(F.split("_asked", "_"))).alias("_piece"))
    shared = parts.filter(F.col("_piece") != "").join(pieces, "_piece")
    # An empty name part is contained in every name, so such tables start at the lower score.
    blank = F.when(F.array_contains(F.split("_asked", "_"), ""), PART_TABLE).otherwise(0.0)
    # The first targets in order, 2 * k at most, fill the places no similar name takes.
    opening = names.orderBy("position").limit(depth).agg(
        F.collect_list(F.struct("position", "target_table")).alias("_first")).scalar()
    rest = asks.withColumn("_first", opening).select("_asked", blank.alias("score"), F.inline("_first")) \
        .select("_asked", "target_table", "position", "score")
    pool = union_all(scored(exact, EXACT_TABLE), scored(within, PARTIAL_TABLE), scored(around, PARTIAL_TABLE),
                     scored(shared, PART_TABLE), rest)
    best = pool.groupBy("_asked", "position", "target_table").agg(F.max("score").alias("score"))
    ranked = top_per_group(best, ["_asked"], [F.col("score").desc(), F.col("position")], k)
    return asked.join(ranked, "_asked").select("source_table", "rank", "target_table", "score")


def gate(confidence: Column, target_column: Column, accept_at: float = ACCEPT_AT) -> Column:
    """accepted, pending or rejected, for proposal counts."""
    return F.when(target_column.isNull() | (target_column == "?") | (confidence == 0.0), "rejected") \
        .when(confidence >= accept_at, "accepted").otherwise("pending")


def review_status(confidence: Column, target_column: Column, accept_at: float = ACCEPT_AT) -> Column:
    """Status of a single field review: here the confidence is looked at first."""
    return F.when(confidence >= accept_at, "accepted") \
        .when((confidence == 0.0) | target_column.isNull() | (target_column == "?"), "rejected") \
        .otherwise("pending")


def gate_counts(proposals: DataFrame, by: str, accept_at: float = ACCEPT_AT) -> DataFrame:
    decided = proposals.withColumn("_gate", gate(F.col("confidence"), F.col("target_column"), accept_at))
    counts = decided.groupBy(by).agg(
        F.count_if(F.col("_gate") == "accepted").alias("auto_approved"),
        F.count_if(F.col("_gate") == "pending").alias("needs_review"),
        F.count_if(F.col("_gate") == "rejected").alias("rejected"))
    return counts.withColumn("status", F.when(F.col("needs_review") == 0, "auto_approved").otherwise("needs_review"))


def unmet_required(catalog: DataFrame, mappings: DataFrame) -> DataFrame:
    """Required target columns no mapping supplies under that column name, whatever the table."""
    exempt = [*sorted(ENVELOPE_FIELDS), "active"]
    needed = catalog.filter(~F.col("nullable") & ~F.col("column_name").isin(*exempt))
    mapped = mappings.select(F.col("target_column").alias("column_name")).distinct()
    return needed.join(mapped, "column_name", "left_anti").select("table_name", "column_name")


def coverage(
    catalog: DataFrame, foreign_keys: DataFrame, mapping: DataFrame, app_assigned: list[str],
) -> DataFrame:
    """Per mapped table: mapped, unknown, missing required and system-filled columns.

    `catalog` adds has_default and generated to the usual columns; `foreign_keys` is (table_name,
    column_name, ref_table); `mapping` is (target_table, target_column).
    """
    filled = foreign_keys.select("table_name", "column_name").distinct().withColumn("_fk", F.lit(True))
    known = catalog.join(filled, ["table_name", "column_name"], "left").select(
        "table_name", "column_name", F.lit(False).alias("_mapped"), F.lit(True).alias("_known"),
        (F.coalesce("_fk", F.lit(False)) | (F.col("table_name").isin(*app_assigned) & F.col("is_primary_key")))
        .alias("_system"), (~F.col("nullable") & ~F.col("has_default") & ~F.col("generated")).alias("_required"))
    mapped = mapping.select(
        F.col("target_table").alias("table_name"), F.col("target_column").alias("column_name"),
        F.lit(True).alias("_mapped"), F.lit(False).alias("_known"), F.lit(False).alias("_system"),
        F.lit(False).alias("_required"))
    flags = ("_mapped", "_known", "_system", "_required")
    columns = union_all(known, mapped).groupBy("table_name", "column_name").agg(
        *[F.bool_or(c).alias(c) for c in flags])

    def names(condition: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, F.col("column_name"))))

    report = columns.groupBy("table_name").agg(
        F.bool_or("_mapped").alias("_used"), F.bool_or("_known").alias("table_exists"),
        names(F.col("_mapped")).alias("mapped_columns"),
        names(~F.col("_known")).alias("unknown_columns"),
        names(F.col("_required") & ~F.col("_system") & ~F.col("_mapped")).alias("required_missing"),
        names(F.col("_system")).alias("system_handled")).filter("_used")
    none = F.array().cast("array<string>")
    there = F.col("table_exists")
    return report.select("table_name", "table_exists", *[
        F.when(there, F.col(c)).otherwise(none).alias(c)
        for c in ("mapped_columns", "unknown_columns", "required_missing", "system_handled")])


def blocking(report: DataFrame, unsatisfiable: DataFrame) -> DataFrame:
    """Every reason why a mapping cannot be deployed, as text."""
    table = F.col("table_name")
    tables = report.filter(~F.col("table_exists")).select(
        table, F.concat(F.lit("target table '"), table, F.lit("' does not exist in the target schema")).alias("problem"))
    unknown = report.select(table, F.explode("unknown_columns").alias("c")).select(
        table, F.concat(table, F.lit("."), F.col("c"), F.lit(" is not a column of "), table).alias("problem"))
    missing = report.select(table, F.explode("required_missing").alias("c")).select(
        table, F.concat(table, F.lit("."), F.col("c"), F.lit(" is required but no source column maps to it"))
        .alias("problem"))
    parents = unsatisfiable.select(table, F.concat(
        table, F.lit("."), F.col("column_name"), F.lit(" requires a "), F.col("ref_table"), F.lit(" row, but "),
        F.col("ref_table"), F.lit(" is neither written by this mapping nor seeded")).alias("problem"))
    return union_all(tables, unknown, missing, parents)


def unsatisfiable_keys(
    catalog: DataFrame, foreign_keys: DataFrame, mapping: DataFrame, seeded: DataFrame
) -> DataFrame:
    """Required unmapped foreign keys whose parent is neither written by the mapping nor seeded."""
    written = mapping.select("target_table").distinct()
    mapped = mapping.select(F.col("target_table").alias("table_name"), F.col("target_column").alias("column_name"))
    need = catalog.filter(~F.col("nullable") & ~F.col("has_default")).select("table_name", "column_name")
    return foreign_keys.filter(F.col("table_name") != F.col("ref_table")) \
        .join(written.select(F.col("target_table").alias("table_name")), "table_name", "left_semi") \
        .join(need, ["table_name", "column_name"], "left_semi") \
        .join(mapped, ["table_name", "column_name"], "left_anti") \
        .join(written.select(F.col("target_table").alias("ref_table")), "ref_table", "left_anti") \
        .join(seeded.select(F.col("table_name").alias("ref_table")), "ref_table", "left_anti") \
        .select("table_name", "column_name", "ref_table")
