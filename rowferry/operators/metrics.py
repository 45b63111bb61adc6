"""Counts over the outbox, the crosswalk and delivery outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .union import union_all


def queue_by_entity(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("source_entity", "status").agg(
        F.count("*").alias("events"), F.min("created_at").alias("oldest"))


def queue_by_status(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("status").agg(F.count("*").alias("events"), F.min("created_at").alias("oldest"))


def unresolved_backlog(quarantine: DataFrame, drift: DataFrame) -> DataFrame:
    def open_count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count_if(F.col("resolved_at").isNull()).alias("unresolved")).select(
            F.lit(name).alias("backlog"), "unresolved")

    return union_all(open_count(quarantine, "quarantine"), open_count(drift, "drift"))


def crosswalk_counts(crosswalk: DataFrame) -> DataFrame:
    return crosswalk.groupBy("target_table").agg(F.count("*").alias("crosswalk_count"))


def _outcome_counts(outcome: Column) -> list[Column]:
    return [F.count("*").alias("claimed"), F.count_if(outcome == "delivered").alias("delivered"),
            F.count_if(outcome == "quarantined").alias("quarantined"), F.count_if(outcome == "retry").alias("retried")]


def run_summary(outcomes: DataFrame, column: str = "outcome") -> DataFrame:
    return outcomes.agg(*_outcome_counts(F.col(column)))


def observed(outcomes: DataFrame, column: str = "outcome") -> tuple[DataFrame, Observation]:
    """The same counts as a by-product of the write that follows."""
    seen = Observation()
    return outcomes.observe(seen, *_outcome_counts(F.col(column))), seen


def reconcile_counts(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Row counts on both sides per key, with the difference."""
    left = source.groupBy(key).agg(F.count("*").alias("source_rows"))
    right = target.groupBy(key).agg(F.count("*").alias("target_rows"))
    both = left.join(right, key, "full_outer").fillna(0, ["source_rows", "target_rows"])
    return both.withColumn("difference", F.col("source_rows") - F.col("target_rows"))


def next_versions(versions: DataFrame, entities: DataFrame) -> DataFrame:
    highest = versions.groupBy("source_entity").agg(F.max("version").alias("_v"))
    return entities.join(highest, "source_entity", "left").select(
        "source_entity", (F.coalesce("_v", F.lit(0)) + 1).alias("next_version"))


def footprint(mapping: DataFrame) -> DataFrame:
    """Sorted distinct target tables of every entity; a target model bounds the size of the list."""
    pairs = mapping.filter(F.col("target_table").isNotNull()).select("source_entity", "target_table").distinct()
    return pairs.groupBy("source_entity").agg(F.sort_array(F.collect_list("target_table")).alias("target_tables"))


# Where job results keep their entries, and the states that count as failed.
_LISTS = ("results", "entities", "redeliver")
_FAILED = ("failed", "skipped", "error")
_ENTRY = "array<struct<entity:string,table:string,source_table:string,status:string,error:string>>"


def job_failures(jobs: DataFrame, key: str = "job_id", result: str = "result") -> DataFrame:
    """Failed, skipped and errored entries inside the JSON results of jobs.

    A list stands under results, entities or redeliver, directly or one object deeper. The top level is
    parsed once into raw texts, and only the lists that are there are parsed further.
    """
    empty = F.array().cast(_ENTRY)

    def entries(name: str) -> Column:
        raw = F.col(f"_top.{name}")
        inner = F.from_json(F.when(raw.startswith("{"), raw), f"results {_ENTRY}, entities {_ENTRY}")
        nested = F.when(F.size(inner["results"]) > 0, inner["results"]).otherwise(inner["entities"])
        listed = F.from_json(F.when(raw.startswith("["), raw), _ENTRY)
        return F.coalesce(listed, nested, empty)

    top = jobs.withColumn("_top", F.from_json(result, ", ".join(f"{n} string" for n in _LISTS)))
    rows = top.select(key, F.explode(F.concat(*[entries(n) for n in _LISTS])).alias("f"))
    state = F.lower(F.coalesce("f.status", F.lit("")))
    failed = state.isin(*_FAILED) | (F.coalesce("f.error", F.lit("")) != "")
    named = F.coalesce(*[F.when(F.col(f"f.{n}") != "", F.col(f"f.{n}")) for n in ("entity", "table", "source_table")])
    return rows.filter(failed).select(
        key, named.alias("entity"),
        F.coalesce(F.when(F.col("f.status") != "", F.col("f.status")), F.lit("failed")).alias("status"),
        F.col("f.error").alias("error"))
