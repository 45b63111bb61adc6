"""Jobs over contracts: scan, mapping proposal and change impact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.drift import (
    affected_entities, contract_changes, entity_fingerprints, impacted_by_breaking, monitor, structural_changes,
)
from ..operators.matching import gate_counts, match_columns, review_status, unmet_required
from ..operators.union import union_all


def contract_scan(
    approved: DataFrame, observed: DataFrame, entities: DataFrame, footprints: DataFrame, source_now: DataFrame,
    system: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, per-entity flags, paused entities) of one look at the contracts.

    An entity is paused by a breaking change below it or by a fingerprint that moved.
    """
    changes = contract_changes(approved, observed)
    flags = monitor(entities, source_now, entity_fingerprints(observed, footprints, system))
    paused = union_all(impacted_by_breaking(changes, footprints),
                       flags.filter("paused").select("source_entity")).distinct()
    return changes, flags, paused


def propose_mapping(
    source: DataFrame, target: DataFrame, catalog: DataFrame,
    proposer: Callable[[DataFrame, DataFrame], DataFrame] = match_columns,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(field reviews, counts per source table, unmet required columns) of a mapping proposal."""
    proposal = proposer(source, target)
    reviews = proposal.withColumn("status", review_status(F.col("confidence"), F.col("target_column")))
    usable = proposal.filter(F.col("target_column").isNotNull() & (F.col("confidence") > 0))
    return reviews, gate_counts(proposal, "source_table"), unmet_required(catalog, usable)


def change_impact(before: DataFrame, after: DataFrame, footprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed tables, affected entities) a new contract would bring; nothing is changed."""
    changed = structural_changes(before, after)
    return changed, affected_entities(footprints, changed)
