"""Delivering source rows into a target: events, entity refresh and full rebuild."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import FieldMapping, TableContract, TargetContract, TargetProfile
from ..functions.keys import reference_for
from ..operators import events as outbox_ops
from ..operators.lookups import (
    CROSSWALK_KEY, carried_ids, entity_crosswalk, live_links, match_or_allocate, propagate_parent, resolve_reference_row,
    resolve_references, rows_of, unresolved,
)
from ..operators.merge import scoped_delete
from ..operators.ordering import by_repeats
from ..operators.projection import ERRORS, stage, usable, without_managed
from ..operators.union import union_all
from ..operators.validation import check_staged, mark_quarantined, quarantine_upsert
from ..sources.workspace import materialise, materialise_all

REFERENCE = "external_reference"
CROSSWALK = "crosswalk"
_ORDER = "_event_order"
_GIVEN = "_given_columns"  # source columns that an event's payload has; null when the row is a whole one

# Reasons why an event cannot be delivered at all.
NO_MAPPING = "no approved target mapping for entity"
NO_VALUES = "mapping produced no target values"


@dataclass(frozen=True)
class Entity:
    """A source table with its approved mappings."""

    name: str
    schema: str
    keys: tuple[str, ...]
    mappings: tuple[FieldMapping, ...]
    row_schema: T.StructType | None = None
    references: dict[str, tuple[str, ...]] = field(default_factory=dict)
    """Candidate source entities per parent table, for foreign keys into other entities."""


@dataclass
class TargetState:
    tables: dict[str, DataFrame]
    crosswalk: DataFrame
    unresolved: DataFrame | None = None
    changed: dict[str, DataFrame] = field(default_factory=dict)
    """Written rows of every table that was touched, `crosswalk` among them, each with its present values."""
    before: dict[str, DataFrame] = field(default_factory=dict)
    """What touched tables were before, so that a table is never more than this and one set of changes."""

    def changing(self, name: str, rows: DataFrame, keys: Sequence[str]) -> TargetState:
        """The state after some rows of a table, or of the crosswalk, were inserted or replaced. The rows are at hand."""
        before = self.before.get(name, self.crosswalk if name == CROSSWALK else self.tables[name])
        if name in self.changed:
            rows = materialise(overlay(self.changed[name], rows, keys))
        now = overlay(before, rows, keys)
        tables = self.tables if name == CROSSWALK else {**self.tables, name: now}
        return replace(self, tables=tables, crosswalk=now if name == CROSSWALK else self.crosswalk,
                       changed={**self.changed, name: rows}, before={**self.before, name: before})


def overlay(current: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A table with some of its rows replaced, and others added."""
    return union_all(current.join(rows.select(*keys), list(keys), "left_anti").select(*current.columns), rows)


@dataclass
class Delivery:
    target: TargetState
    outbox: DataFrame
    quarantine: DataFrame
    envelope: DataFrame
    outcomes: DataFrame
    audit: DataFrame
    """Attempts of this pass: accepted, retry or dead letter."""
    changed: dict[str, DataFrame] = field(default_factory=dict)
    """Rows of the outbox, the quarantine and the envelope that this pass touched."""


def _links(ids: DataFrame, entity: str, system: str, target: str, table: str) -> DataFrame:
    """Crosswalk rows of written ids."""
    return ids.select(
        F.lit(system).alias("source_system"), F.lit(entity).alias("source_entity"), REFERENCE,
        F.lit(target).alias("target_system"), F.lit(table).alias("target_table"),
        F.col("target_id").cast("string").alias("target_id"))


def _written_rows(current: DataFrame, rows: DataFrame, pk: str, mapped: Sequence[str], keys: Sequence[str],
                  sources: dict[str, str]) -> DataFrame:
    """Rows that are inserted or updated, by id. Mapped columns are set, foreign keys only when known, others stay.

    A mapped column whose source column the payload does not have stays too; `sources` names the source columns. Of rows that
    share an id the last one writes, by event and then by reference.
    """
    writing = rows.filter(F.col("action").isin("insert", "update"))
    new, of = F.struct(*mapped, *keys, _GIVEN), F.col("target_id").alias(pk)
    single, several = by_repeats(writing, "target_id")
    changed = union_all(single.select(of, new.alias("_new")),
                        several.groupBy(of).agg(F.max_by(new, F.struct(_ORDER, REFERENCE)).alias("_new")))
    both = changed.join(rows_of(current, writing.select(of), pk), pk, "left")
    columns = []
    for f in current.schema.fields:
        old = F.col(f.name)
        if f.name == pk:
            columns.append(old)
        elif f.name in mapped:
            new = F.col(f"_new.{f.name}").cast(f.dataType)
            given = F.col(f"_new.{_GIVEN}")
            sent = given.isNull() | F.array_contains(given, sources[f.name])
            columns.append(F.when(sent, new).otherwise(old).alias(f.name))
        elif f.name in keys:
            columns.append(F.coalesce(F.col(f"_new.{f.name}").cast(f.dataType), old).alias(f.name))
        else:
            columns.append(old)
    return both.select(*columns)


def row_failures(
    staged: DataFrame, key: str, state: TargetState, entity: Entity, contract: TargetContract, profile: TargetProfile,
    system: str, order: Column | None = None,
) -> DataFrame | None:
    """(`key`, `error`) for rows that cannot be written: lookup rows that are not there, required foreign keys and
    required columns of new rows that stay empty. None when no table of the mapping can fail that way.

    With `order`, rows of one reference are events that follow each other: a new row's required columns may have come
    with an earlier event that does not fail itself.
    """
    names = [f.name for f in staged.schema.fields if contract.table(f.name) is not None]
    partial = _GIVEN in staged.columns
    found: list[DataFrame] = []
    needed: dict[str, dict[str, str]] = {}
    for name in names:
        table = contract.table(name)
        mapped = staged.schema[name].dataType.names
        sources = _sources(entity, name)
        if _is_lookup(table, mapped, profile):
            # An event that gives none of the values leaves the lookup alone.
            asked = staged.filter(_gives(*[sources[c] for c in mapped if c in sources])) if partial else staged
            rows = resolve_reference_row(asked.select(key, REFERENCE, f"{name}.*"), mapped, state.tables[name],
                                         table.primary_key, name)
            found.append(rows.filter(F.col("lookup_error").isNotNull()).select(key, F.col("lookup_error").alias("error")))
            continue
        needed[name] = {c.name: sources[c.name] for c in table.columns if not c.nullable and c.name in mapped and c.name in sources}
        for fk in table.foreign_keys:
            column = table.column(fk.column)
            if column is None or column.nullable or not entity.references.get(fk.ref_table) or fk.column not in sources:
                continue
            needed[name][fk.column] = sources[fk.column]
            given = F.col(f"_source.{sources[fk.column]}")
            asked = staged.filter(_gives(sources[fk.column])) if partial else staged
            rows = resolve_references(
                asked.select(key, given.alias("_value")), "_value", "_found", state.crosswalk.filter(F.col("target_table") == fk.ref_table),
                state.tables[fk.ref_table], fk.ref_column, entity.references[fk.ref_table], system, entity.schema, [key])
            text = F.concat(F.lit(f"required foreign key {name}.{fk.column} has no row for "), F.coalesce(
                F.col("_value").cast("string"), F.lit("null")))
            found.append(rows.filter(F.col("_found").isNull()).select(key, text.alias("error")))
    needed = {name: columns for name, columns in needed.items() if columns}
    if partial and needed:
        others = materialise(union_all(*found)) if found else None
        sound = staged if others is None else staged.join(others.select(key).distinct(), key, "left_anti")
        found = [others] if others is not None else []
        for name, columns in needed.items():
            known = entity_crosswalk(state.crosswalk, entity.name, profile.name, name)
            found += _incomplete(sound, key, name, columns, known, state.tables[name], contract.table(name).primary_key, order)
    return union_all(*found) if found else None


def _gives(*sources: str) -> Column:
    """Whether the payload of a row has one of the source columns; a row without a list of names has all."""
    return F.col(_GIVEN).isNull() | F.arrays_overlap(_GIVEN, F.array(*map(F.lit, sources)))


def _incomplete(events: DataFrame, key: str, name: str, columns: dict[str, str], links: DataFrame, target: DataFrame, pk: str,
                order: Column | None) -> list[DataFrame]:
    """Events of rows that the target does not have yet, without a required column up to then; no frame if all events are whole."""
    partial = events.filter(~F.forall(F.array(*[_gives(s) for s in columns.values()]), lambda c: c))
    if partial.isEmpty():
        return []
    new = partial.join(live_links(partial, links, target, pk).select(REFERENCE), REFERENCE, "left_anti")
    lacks = {c: ~_gives(s) for c, s in columns.items()}
    if order is not None:
        # The first event with each column, one row per reference: no event has to meet all others of its reference.
        first = events.groupBy(REFERENCE).agg(*[F.min(F.when(_gives(s), order)).alias(f"_first_{c}") for c, s in columns.items()])
        new = new.join(first, REFERENCE)
        lacks = {c: lack & (F.col(f"_first_{c}").isNull() | (F.col(f"_first_{c}") > order)) for c, lack in lacks.items()}
    absent = F.filter(F.array(*[F.when(lack, F.lit(f"{name}.{c}")) for c, lack in lacks.items()]), lambda c: c.isNotNull())
    return [new.select(key, absent.alias("_absent")).filter(F.size("_absent") > 0).select(
        key, F.concat(F.lit("a new row needs "), F.array_join("_absent", ", ")).alias("error"))]


def folded_events(events: DataFrame, entity: Entity, contract: TargetContract, head: Sequence[str]) -> DataFrame:
    """Staged events of every row as one: each column from the last event that has it.

    That is the state which applying the events in order would leave. Everything is an aggregate that is combined before the
    shuffle, so a row with a third of all events sends one row per task. Columns that no event has stay absent. A row's only event
    is the row, and needs no aggregate.
    """
    order = event_order()
    tables = [f for f in events.schema.fields if contract.table(f.name) is not None]
    carried = [c for c in events.schema["_source"].dataType.names if c != "_"]
    known = sorted({m.source_column for m in entity.mappings})

    def parts(last: Callable[[Column, Column], Column], some: Callable[[Column], Column]) -> list[Column]:
        found = [last(F.struct(*[c for c in head if c != REFERENCE]), F.lit(True)).alias("_head")]
        for table in tables:
            sources = _sources(entity, table.name)
            found += [last(F.col(f"{table.name}.{c}"), _gives(sources.get(c, c))).alias(f"_{table.name}.{c}") for c in table.dataType.names]
        found += [last(F.col(f"_source.{c}"), _gives(c)).alias(f"_source.{c}") for c in carried]
        return found + [some(F.col(_GIVEN).isNull()).alias("_whole"), *[some(_gives(c)).alias(f"_gives.{c}") for c in known]]

    single, several = by_repeats(events, REFERENCE)
    rows = union_all(
        single.select(REFERENCE, *parts(lambda value, given: F.when(given, value), lambda c: c)),
        several.groupBy(REFERENCE).agg(*parts(lambda value, given: F.max_by(value, F.when(given, order)), F.max)))
    given = F.filter(F.array(*[F.when(F.col(f"`_gives.{c}`"), F.lit(c)) for c in known]), lambda c: c.isNotNull())
    return rows.select(
        REFERENCE, "_head.*", F.when(F.col("_whole"), F.lit(None)).otherwise(given).alias(_GIVEN),
        F.struct(*[F.col(f"`_source.{c}`").alias(c) for c in carried], F.lit(True).alias("_")).alias("_source"),
        *[F.struct(*[F.col(f"`_{t.name}.{c}`").alias(c) for c in t.dataType.names]).alias(t.name) for t in tables])


def event_order() -> Column:
    """Events by the time of their change; a missing time counts as earliest."""
    return F.struct("source_updated_at", "created_at", "event_id")


def _sources(entity: Entity, table: str) -> dict[str, str]:
    return {m.target_column: m.source_column for m in entity.mappings if m.target_table == table and m.target_column}


def _is_lookup(table: TableContract, mapped: Sequence[str], profile: TargetProfile) -> bool:
    return table.name in profile.lookup_tables or (
        table.lookup_only and table.name not in profile.app_assigned and table.primary_key not in mapped)


def write_rows(
    staged: DataFrame, state: TargetState, entity: Entity, contract: TargetContract, profile: TargetProfile,
    system: str,
) -> TargetState:
    """Writes staged rows, one per reference, into all their tables, parents first.

    Only the rows written are stored; tables are read as what they were with these rows laid over.
    """
    names = [f.name for f in staged.schema.fields if contract.table(f.name) is not None]
    now = replace(state, unresolved=None)
    produced: dict[str, DataFrame] = {}
    misses: list[DataFrame] = []
    links_of: list[DataFrame] = []
    for name in contract.parents_first(names):
        table = contract.table(name)
        mapped = staged.schema[name].dataType.names
        rows, links, missed = _foreign_keys(staged, table, entity, state, produced, system)
        misses += missed
        known = entity_crosswalk(now.crosswalk, entity.name, profile.name, name)
        pk = table.primary_key
        if _is_lookup(table, mapped, profile):
            produced[name] = resolve_reference_row(rows, mapped, now.tables[name], pk, name).select(REFERENCE, "target_id")
            continue
        if pk in mapped:
            ids = carried_ids(rows, known, pk, now.tables[name]).withColumn(
                "target_id", F.col("target_id").cast(now.tables[name].schema[pk].dataType))
            mapped = [c for c in mapped if c != pk]
        else:
            # Foreign keys tell rows apart as well as the mapped values do.
            natural = [*mapped, *links] if name in profile.app_assigned else ()
            start = profile.id_start if name in profile.app_assigned else 1
            rows = materialise(rows) if natural and links else rows
            ids = match_or_allocate(rows, known, now.tables[name], pk, start, natural)
        ids = materialise(ids)
        produced[name] = ids.select(REFERENCE, "target_id")
        now = now.changing(name, materialise(_written_rows(now.tables[name], ids, pk, mapped, links, _sources(entity, name))), [pk])
        links_of.append(_links(ids, entity.name, system, profile.name, name))
    if links_of:  # of one entity, so links of different tables have different keys
        now = now.changing(CROSSWALK, union_all(*links_of), CROSSWALK_KEY)
    return replace(now, unresolved=union_all(*misses) if misses else None)


def _foreign_keys(
    staged: DataFrame, table: TableContract, entity: Entity, state: TargetState, produced: dict[str, DataFrame],
    system: str,
) -> tuple[DataFrame, list[str], list[DataFrame]]:
    """Rows of one table with their foreign keys: source references first, then parents of the same row."""
    sources = {m.target_column: m.source_column for m in entity.mappings if m.target_table == table.name}
    referring = [fk for fk in table.foreign_keys if fk.column in sources and entity.references.get(fk.ref_table)]
    carried = [F.col(f"_source.{sources[fk.column]}").alias(f"_from_{fk.column}") for fk in referring]
    given = F.col(_GIVEN) if _GIVEN in staged.columns else F.lit(None).cast("array<string>")
    mapped = [sources[c] for c in staged.schema[table.name].dataType.names if c in sources]
    if _GIVEN in staged.columns:  # a payload without any column of a table has no row for it
        staged = staged.filter(_gives(*mapped, *[sources[fk.column] for fk in referring]))
    follows = event_order() if "event_id" in staged.columns else F.lit(0)
    rows = staged.select(REFERENCE, F.col(f"{table.name}.*"), given.alias(_GIVEN), follows.alias(_ORDER), *carried)
    misses: list[DataFrame] = []
    for fk in referring:
        given = f"_from_{fk.column}"
        rows = resolve_references(
            rows, given, fk.column, state.crosswalk.filter(F.col("target_table") == fk.ref_table),
            state.tables[fk.ref_table], fk.ref_column, entity.references[fk.ref_table], system, entity.schema, [REFERENCE])
        misses.append(unresolved(rows, given, fk.column, table.name, fk.column)
                      .withColumn("source_column", F.lit(sources[fk.column])))
    links = [fk.column for fk in referring]
    for fk in table.foreign_keys:
        if fk.ref_table in produced and fk.ref_table != table.name:
            rows = propagate_parent(rows, fk.column, produced[fk.ref_table])
            links += [fk.column] if fk.column not in links else []
    return rows.drop(*[f"_from_{fk.column}" for fk in referring]), links, misses


def stage_rows(rows: DataFrame, entity: Entity, contract: TargetContract, keep: Sequence[str], as_of: Column | None,
               given: str | None = None) -> DataFrame:
    """Staged and checked rows; the source columns of foreign keys ride along in `_source`.

    With `given`, the names a payload has, a required column that is not among them is no error yet.
    """
    sources = [m.source_column for m in entity.mappings
               if m.target_table and contract.table(m.target_table)
               and m.target_column in contract.table(m.target_table).managed_columns and m.source_column in rows.columns]
    carried = F.struct(*[F.col(c) for c in dict.fromkeys(sources)], F.lit(True).alias("_")).alias("_source")
    return check_staged(stage(rows.withColumn("_source", carried), entity.mappings, contract,
                              [*keep, "_source"], as_of), contract,
                        None if given is None else lambda table, column: F.array_contains(
                            given, _sources(entity, table).get(column, column)))


def decode_payload(due: DataFrame, entity: Entity, head: Sequence[str]) -> DataFrame:
    """Events with the columns of their payload, the names it has, and an error for each value that cannot be read."""
    keys = F.json_object_keys("payload")
    row = F.from_json("payload", entity.row_schema)
    opened = due.select(*head, F.coalesce(keys, F.array().cast("array<string>")).alias(_GIVEN), keys.isNull().alias("_bad"), row.alias("_row"))
    # The value is looked for only where the row has none, as every search reads the payload anew.
    wrong = [F.when(F.col(f"_row.{f.name}").isNull() & F.get_json_object("payload", f"$['{f.name}']").isNotNull(),
                    F.lit(f"payload value of {f.name} is no {f.dataType.simpleString()}")) for f in entity.row_schema.fields]
    errors = F.filter(F.array(F.when(F.col("_bad"), F.lit("payload is no JSON object")), *wrong), lambda e: e.isNotNull())
    return opened.select(*head, _GIVEN, errors.alias("_payload_errors"), "_row.*")


def deliver_events(
    outbox: DataFrame, control: DataFrame, state: TargetState, quarantine: DataFrame, envelope: DataFrame,
    entity: Entity, contract: TargetContract, profile: TargetProfile, system: str, as_of: Column,
    limit: int | None = None,
) -> Delivery:
    """One delivery pass over the due events of an entity.

    Events whose content is wrong are quarantined one by one. Events that miss something in the target, such as a
    lookup row, are tried again later, or end as dead letters. The other events of a row are folded into one, column by
    column, which leaves the state that applying them in order would leave.
    """
    due = outbox_ops.claimable(outbox.filter(F.col("source_entity") == entity.name), control, as_of)
    if limit is not None:
        due = outbox_ops.oldest(due, "created_at", "event_id", limit)
    head = ["event_id", REFERENCE, "source_entity", "operation", "source_updated_at", "created_at",
            "payload", "payload_checksum"]
    carry = [*head, _GIVEN, "_payload_errors"]
    known = [] if entity.row_schema is None else entity.row_schema.names
    if usable(without_managed(entity.mappings, contract), known):
        rows = decode_payload(due, entity, head)
        staged = stage_rows(rows, entity, contract, carry, as_of, given=_GIVEN)
        staged = staged.withColumn(ERRORS, F.concat("_payload_errors", ERRORS)).drop("_payload_errors")
        # Payloads are long, and what is read of them later is what is wrong.
        staged = materialise(staged.withColumn("payload", F.when(F.size(ERRORS) > 0, F.col("payload"))))
        good = staged.filter(F.size(ERRORS) == 0)
        failures = row_failures(good, "event_id", state, entity, contract, profile, system, event_order())
    else:
        reason = NO_VALUES if entity.mappings else NO_MAPPING
        staged = materialise(due.select(*head, F.array(F.lit(reason)).alias(ERRORS)))
        good, failures = staged.filter(F.size(ERRORS) == 0), None
    if failures is None:
        failures = staged.select("event_id", F.lit("").alias("error")).limit(0)
    failures = materialise(failures)
    good = good.join(failures.select("event_id").distinct(), "event_id", "left_anti")
    bad = staged.filter(F.size(ERRORS) > 0)
    # Of a row's last event the order goes on.
    target = state if not usable(without_managed(entity.mappings, contract), known) else write_rows(
        materialise(folded_events(good, entity, contract, ["event_id", "source_updated_at", "created_at"])),
        state, entity, contract, profile, system)
    failed = bad.select("event_id", F.col(ERRORS).alias("errors"), F.col("payload").alias("payload_snapshot"))
    delivered, accepted = outbox_ops.mark_delivered(outbox, good, as_of)
    after = outbox_ops.fail(mark_quarantined(delivered, failed, as_of), failures, as_of)
    outcomes = union_all(
        good.select("event_id", F.lit("delivered").alias("outcome"), F.lit("").alias("message")),
        bad.select("event_id", F.lit("quarantined").alias("outcome"), F.array_join(ERRORS, "; ").alias("message")),
        failures.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("message"))
        .select("event_id", F.lit("retried").alias("outcome"), "message"))
    return Delivery(target, after, quarantine_upsert(quarantine, failed),
                    outbox_ops.upsert_envelope(envelope, outbox_ops.envelope(good, as_of)), outcomes,
                    union_all(accepted, outbox_ops.failed_attempts(outbox, failures)))


def deliver_all(
    outbox: DataFrame, control: DataFrame, state: TargetState, quarantine: DataFrame, envelope: DataFrame,
    entities: Sequence[Entity], contract: TargetContract, profile: TargetProfile, system: str, as_of: Column,
    limit: int | None = None,
) -> Delivery:
    """One pass over the due events of all entities, the oldest `limit` of them; entities follow each other by name.

    Entities share the target, so each starts from what the one before left. Events of other entities stay as they are.
    """
    ready = outbox_ops.claimable(outbox, control, as_of).select(*outbox.columns)
    claimed = ready if limit is None else outbox_ops.oldest(ready, "created_at", "event_id", limit)
    claimed = materialise(claimed.repartition("event_id"))  # however few files or tasks the events come from
    ids = claimed.select("event_id")
    of = {r["source_entity"] for r in claimed.select("source_entity").distinct().collect()}  # as many as there are entities
    # Each entity meets its own events alone, and every table is stored as the rows that the pass writes.
    named = F.col("event_id").cast("string")
    held, letters = materialise_all(rows_of(quarantine, ids, "event_id"), rows_of(envelope, ids.select(named.alias("event_id")), "event_id"))
    after, kept, sent, outcomes, audit, misses = [], [], [], [], [], []
    for entity in sorted(entities, key=lambda e: e.name):
        if entity.name not in of:
            continue
        mine = claimed.filter(F.col("source_entity") == entity.name)
        some = mine.select("event_id")
        done = deliver_events(mine, control, state, held.join(some, "event_id", "left_semi"),
                              letters.join(some.select(named.alias("event_id")), "event_id", "left_semi"), entity, contract, profile,
                              system, as_of)
        state = done.target
        for parts, frame in zip((after, kept, sent, audit), materialise_all(done.outbox, done.quarantine, done.envelope, done.audit)):
            parts.append(frame)
        outcomes.append(done.outcomes)
        misses += [state.unresolved] if state.unresolved is not None else []
    if not after:
        nothing = outbox.limit(0)
        none = nothing.select("event_id", F.lit("").alias("outcome"), F.lit("").alias("message"))
        tried = nothing.select("event_id", F.lit(0).alias("attempt"), F.lit("").alias("outcome"), F.lit("").alias("response_code"))
        return Delivery(state, outbox, quarantine, envelope, none, tried)
    changed = {"outbox": union_all(*after), "quarantine": union_all(*kept), "envelope": union_all(*sent)}
    return Delivery(
        replace(state, unresolved=union_all(*misses) if misses else None), overlay(outbox, changed["outbox"], ["event_id"]),
        overlay(quarantine, changed["quarantine"], ["event_id"]), overlay(envelope, changed["envelope"], ["event_id"]),
        union_all(*outcomes), union_all(*audit), changed)


def durable(state: TargetState) -> TargetState:
    """The state with every table written, so that later steps neither repeat nor undo what led to it."""
    return TargetState({n: materialise(df) for n, df in state.tables.items()}, materialise(state.crosswalk), state.unresolved)


def entities_of(mappings: DataFrame, known: dict[str, Entity]) -> list[Entity]:
    """Entities with the mappings of an approved-mapping frame; mappings are settings, a few rows per entity."""
    found: dict[str, list[FieldMapping]] = {}
    for r in mappings.orderBy("source_entity", "target_table", "target_column", "source_column").collect():
        found.setdefault(r["source_entity"], []).append(
            FieldMapping(r["source_column"], r["target_table"], r["target_column"], r["transform"]))
    return [replace(entity, mappings=tuple(found.get(name, ()))) for name, entity in sorted(known.items())]


def refresh_entity(
    source: DataFrame, state: TargetState, entity: Entity, contract: TargetContract, profile: TargetProfile,
    system: str, as_of: Column | None = None,
) -> tuple[TargetState, DataFrame, DataFrame]:
    """Replaces everything an entity wrote by its current rows.

    Returns the new state, the rows that failed with their errors, and the deleted rows per table.
    """
    scope = {n: (df, contract.table(n).primary_key) for n, df in state.tables.items()}
    kept_back = [n for n in scope if contract.table(n).lookup_only]
    left, crosswalk, deleted = scoped_delete(scope, state.crosswalk, entity.name, profile.name, kept_back)
    keyed = source.withColumn(REFERENCE, reference_for(source, system, entity.schema, entity.name, entity.keys))
    staged = materialise(stage_rows(keyed, entity, contract, [REFERENCE], as_of))
    good, bad = staged.filter(F.size(ERRORS) == 0), staged.filter(F.size(ERRORS) > 0).select(REFERENCE, F.col(ERRORS).alias("errors"))
    emptied = TargetState(left, crosswalk)
    failures = row_failures(good, REFERENCE, emptied, entity, contract, profile, system)
    if failures is not None:
        failures = materialise(failures.groupBy(REFERENCE).agg(F.array_sort(F.collect_set("error")).alias("errors")))
        good, bad = good.join(failures.select(REFERENCE), REFERENCE, "left_anti"), union_all(bad, failures)
    return write_rows(good, emptied, entity, contract, profile, system), bad, deleted


def rebuild_target(
    sources: dict[str, DataFrame], entities: Sequence[Entity], empty: TargetState, contract: TargetContract,
    profile: TargetProfile, system: str, publish: Callable[[str, TargetState], TargetState],
) -> tuple[TargetState, dict[str, str]]:
    """Refreshes every entity from an emptied target; a failing entity is reported and the rest goes on.

    `publish` runs an entity's refresh and makes its tables durable, so that a failure stays with its entity and no later
    one can touch what was written; `durable` does for tables without a store of their own.
    """
    state, report = empty, {}
    for entity in entities:
        try:
            after, _, _ = refresh_entity(sources[entity.name], state, entity, contract, profile, system)
            state = publish(entity.name, after)
            report[entity.name] = "delivered"
        except Exception as error:  # one entity must not end the run
            report[entity.name] = f"failed: {error}"
    return state, report
