"""Ids of target rows: crosswalk lookups, reference lookups, allocation and foreign keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import external_reference
from ..functions.text import match_key
from ..sources.workspace import materialise
from .ordering import allocate_ids, first_match
from .skew import is_small, spread_join
from .union import union_all

CROSSWALK_KEY = ("source_system", "source_entity", "external_reference", "target_system", "target_table")


def crosswalk_lookup(rows: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Adds target_id over the five crosswalk keys, null where there is none."""
    known = crosswalk.select(*CROSSWALK_KEY, "target_id")
    return rows.join(known, list(CROSSWALK_KEY), "left")


def entity_crosswalk(crosswalk: DataFrame, entity: str, system: str, table: str) -> DataFrame:
    """(external_reference, target_id) of one entity and target table."""
    return crosswalk.filter(
        (F.col("source_entity") == entity) & (F.col("target_system") == system)
        & (F.col("target_table") == table) & F.col("target_id").isNotNull()
    ).select("external_reference", "target_id")


def stale_crosswalk(crosswalk: DataFrame, target: DataFrame, pk: str) -> DataFrame:
    """Crosswalk rows whose target row is gone."""
    return crosswalk.join(target.select(F.col(pk).cast("string").alias("target_id")).distinct(),
                          "target_id", "left_anti")


def live_crosswalk(crosswalk: DataFrame, target: DataFrame, pk: str) -> DataFrame:
    return crosswalk.join(target.select(F.col(pk).cast("string").alias("target_id")), "target_id", "left_semi")


def rows_of(table: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Rows of a table whose key is among the asked ones.

    In a large table the keys are looked for alone first, so that its rows are brought to the asked keys only where some are there.
    """
    asked = asked.select(key)
    if is_small(table):
        return table.join(asked, key, "left_semi")
    there = materialise(table.select(key).join(asked, key, "left_semi"))
    return table.limit(0) if there.isEmpty() else table.join(there, key, "left_semi")


def live_links(rows: DataFrame, crosswalk: DataFrame, target: DataFrame, pk: str) -> DataFrame:
    """The part of `live_crosswalk` that belongs to the references of the rows."""
    return live_crosswalk(rows_of(crosswalk, rows, "external_reference"), target, pk)


def resolve_by_key(rows: DataFrame, column: str, lookup: DataFrame, pk: str, table: str) -> DataFrame:
    """Checks a supplied lookup id. Adds target_id, or lookup_error; nothing is ever inserted."""
    found = lookup.select(F.col(pk).alias(column), F.col(pk).alias("target_id"))
    missing = F.concat(F.lit(f"{table}.{pk}="), F.col(column).cast("string"),
                       F.lit(f" does not exist; {table} is read-only"))
    empty = F.lit(f"cannot resolve a row in reference table {table}: no lookup values mapped")
    return rows.join(found, column, "left").withColumn(
        "lookup_error", F.when(F.col(column).isNull(), empty).when(F.col("target_id").isNull(), missing))


def resolve_reference_row(rows: DataFrame, columns: Sequence[str], lookup: DataFrame, pk: str, table: str) -> DataFrame:
    """Lookup id by the key where a row has it, else by its other values. Adds target_id and lookup_error."""
    others = [c for c in columns if c != pk]
    if pk not in columns:
        found = resolve_by_values(rows, others, lookup, pk)
        return found.withColumn("lookup_error", _value_error(others, table))
    keyed = resolve_by_key(rows, pk, lookup, pk, table)
    if not others:
        return keyed
    by_values = resolve_by_values(keyed.withColumnRenamed("target_id", "_keyed"), others, lookup, pk, F.col(pk).isNull())
    error = F.when(F.col(pk).isNotNull(), F.col("lookup_error")).otherwise(_value_error(others, table))
    return by_values.withColumn("lookup_error", error).withColumn("target_id", F.coalesce("_keyed", "target_id")).drop("_keyed")


def _value_error(columns: Sequence[str], table: str) -> Column:
    given = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])
    none = F.lit(f"cannot resolve a row in reference table {table}: no lookup values mapped")
    return F.when(F.col("target_id").isNull(), F.when(given == "", none).otherwise(
        F.concat(F.lit(f"no row of {table} matches "), given)))


def _comparable(column: str, dtype: T.DataType) -> Column:
    """A value in the type of the lookup; null where it is not given or does not fit."""
    value = F.col(column).try_cast(dtype)
    return value + F.lit(0.0) if isinstance(dtype, (T.DoubleType, T.FloatType)) else value  # minus zero equals zero


def _natural_key(columns: Sequence[str], schema: T.StructType) -> Column:
    """Text of the given columns of a row and their values; null if none is given, or if one does not fit its type."""
    values = [_comparable(c, schema[c].dataType) for c in columns]
    fits = [F.col(c).isNull() | v.isNotNull() for c, v in zip(columns, values)]
    given = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in columns])
    whole = F.forall(F.array(*fits), lambda f: f)
    return F.when(given & whole, F.to_json(F.struct(*[v.cast("string").alias(f"v{i}") for i, v in enumerate(values)])))


def _by_selectivity(lookup: DataFrame, columns: Sequence[str]) -> list[int]:
    """Places of the columns, those with most distinct values first: one pass, one row."""
    counts = lookup.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return sorted(range(len(columns)), key=lambda i: (-counts[i], i))


def resolve_by_values(
    rows: DataFrame, columns: Sequence[str], lookup: DataFrame, pk: str, wanted: Column | None = None,
    weigh: DataFrame | None = None,
) -> DataFrame:
    """Natural-key lookup where only the non-null values of a row have to agree.

    Equal sets of given values are looked up once. Each meets the lookup on its most selective given column, an equality
    join in which the other given columns are compared; the smallest key of what is left wins. Any number of columns and of
    sets of given columns may occur: what reaches the driver is one row of distinct counts and the columns joined on.
    Rows outside `wanted` are not looked up. With `weigh`, a frame that has the value columns, heavy values are spread on
    the way back to the rows; without it Spark broadcasts what was found if that is small.
    """
    schema = lookup.select(*columns).schema
    key = _natural_key(columns, schema)
    keyed = rows.withColumn("_key", key if wanted is None else F.when(wanted, key))
    # One struct of values instead of a column each: the optimiser follows every renamed column through each filter.
    values = F.struct(*[_comparable(c, schema[c].dataType).alias(f"v{i}") for i, c in enumerate(columns)])
    asked = keyed.filter(F.col("_key").isNotNull()).select("_key", values.alias("_v")).dropDuplicates(["_key"])
    order = _by_selectivity(lookup, columns)
    text_of = lambda side, i: F.concat(F.lit(f"{i}:"), F.col(f"{side}.v{i}").cast("string"))
    on = F.coalesce(*[F.when(F.col(f"_v.v{i}").isNotNull(), F.lit(i)) for i in order])
    asked = asked.withColumns({"_on": on, "_value": F.coalesce(*[text_of("_v", i) for i in order])})
    joined_on = list(range(len(columns)))
    if not is_small(lookup):  # a large lookup is repeated for the columns that are joined on, no more
        asked = materialise(asked)
        joined_on = sorted(r[0] for r in asked.select("_on").distinct().collect())  # no more than there are columns
    offered = lookup.select(F.col(pk).alias("_pk"), values.alias("_w"))
    entries = F.array(*[text_of("_w", i) for i in joined_on]) if joined_on else F.array().cast("array<string>")
    offered = offered.select("_pk", "_w", F.explode(F.filter(entries, lambda v: v.isNotNull())).alias("_value"))
    agree = F.forall(F.array(*[F.col(f"_v.v{i}").isNull() | F.coalesce(F.col(f"_v.v{i}") == F.col(f"_w.v{i}"), F.lit(False))
                               for i in range(len(columns))]), lambda same: same)
    found = asked.drop("_on").join(offered, "_value").filter(agree).groupBy("_key").agg(F.min("_pk").alias("target_id"))
    if weigh is None:
        return keyed.join(found, "_key", "left").drop("_key")
    return spread_join(keyed, found, "_key", "left", ["external_reference"], weigh=weigh.select(key.alias("_key"))).drop("_key")


def match_or_allocate(
    rows: DataFrame, crosswalk: DataFrame, target: DataFrame, pk: str, start: int,
    natural: Sequence[str] = (), weigh: DataFrame | None = None,
) -> DataFrame:
    """Target id of every row, and how it came about.

    `rows` has one row per external_reference; `crosswalk` is (external_reference, target_id) of this
    entity and table. A live crosswalk id is updated; otherwise a target row with the same natural key
    is matched; otherwise a new id is allocated, one per natural key, so that rows describing the same
    new thing share it. Ids follow the references, so a second run gives the same ones. `weigh` may name a
    cheaper frame with the natural columns to find heavy values in.
    """
    id_type = target.schema[pk].dataType
    live = live_links(rows, crosswalk, target, pk).select(
        "external_reference", F.col("target_id").cast(id_type).alias("_live"))
    known = rows.join(live, "external_reference", "left")
    found = F.col("_live")
    if natural:
        known = resolve_by_values(known, natural, target.select(pk, *natural), pk, F.col("_live").isNull(),
                                  rows if weigh is None else weigh) \
            .withColumnRenamed("target_id", "_match")
        found = F.coalesce("_live", "_match")
    known = materialise(known)  # read several times below: settled rows, groups, new ids
    settled = known.filter(found.isNotNull()).withColumns({
        "target_id": found, "action": F.when(F.col("_live").isNotNull(), "update").otherwise("match")})
    fresh = known.filter(found.isNull())
    first = F.greatest(F.lit(start), F.coalesce(F.max(pk) + 1, F.lit(start))).cast("bigint")
    first_id = target.agg(first.alias("_first")).scalar()
    if natural:
        given = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in natural])
        same = F.when(given, F.to_json(F.struct(*natural))).otherwise(F.col("external_reference"))
        fresh = fresh.withColumn("_same", same)
        groups = fresh.groupBy("_same").agg(F.min("external_reference").alias("_ref"))
        ids = allocate_ids(groups, "_ref", "target_id", first_id).select(
            "_same", "_ref", F.col("target_id").cast(id_type).alias("target_id"))
        action = F.when(F.col("external_reference") == F.col("_ref"), "insert").otherwise("match")
        fresh = spread_join(fresh, ids, "_same", "inner", ["external_reference"]) \
            .withColumn("action", action).drop("_same", "_ref")
    else:
        fresh = allocate_ids(fresh, "external_reference", "target_id", first_id).withColumns({
            "target_id": F.col("target_id").cast(id_type), "action": F.lit("insert")})
    return union_all(settled, fresh).drop("_live", "_match")


def carried_ids(rows: DataFrame, crosswalk: DataFrame, pk: str, target: DataFrame | None = None,
                order: Sequence[str] = ()) -> DataFrame:
    """Ids the source itself supplies: the recorded id wins, else the mapped key is used.

    With the target table a recorded id whose row is gone counts as absent, and of rows that end up with one id only the
    last in the given order (then by reference) writes; the others are a match.
    """
    known = crosswalk if target is None else live_links(rows, crosswalk, target, pk)
    known = known.select("external_reference", F.col("target_id").alias("_known"))
    found = rows.join(known, "external_reference", "left").withColumns({
        "target_id": F.coalesce(F.col("_known"), F.col(pk).cast("string")),
        "action": F.when(F.col("_known").isNull(), "insert").otherwise("update"),
    }).drop("_known")
    if target is None:
        return found
    ranks = [*[F.col(c) for c in order], F.col("external_reference")]
    last = found.filter(F.col("target_id").isNotNull()).groupBy("target_id").agg(
        F.max(F.struct(*ranks)).alias("_last")).select("target_id", F.col("_last.external_reference").alias("_writer"))
    return found.join(last, "target_id", "left").withColumn("action", F.when(
        F.coalesce(F.col("_writer") != F.col("external_reference"), F.lit(False)), "match").otherwise(F.col("action"))).drop("_writer")


def propagate_parent(child: DataFrame, column: str, parent_ids: DataFrame) -> DataFrame:
    """Fills an empty foreign key with the id its parent got for the same source row."""
    ids = parent_ids.select("external_reference", F.col("target_id").alias("_parent"))
    filled = child.join(ids, "external_reference", "left")
    given = F.col(column) if column in child.columns else F.lit(None)
    return filled.withColumn(column, F.coalesce(given, F.col("_parent"))).drop("_parent")


def resolve_references(
    rows: DataFrame, column: str, output: str, crosswalk: DataFrame, parent: DataFrame, parent_pk: str,
    entities: Sequence[str], system: str, schema: str, row_key: Sequence[str],
) -> DataFrame:
    """Turns a source foreign key into the id its row got in the target.

    The value may belong to any of the candidate entities, tried in name order, and counts only when
    the target row is still there. Values are made distinct before they meet the crosswalk; the way
    back to the rows spreads heavy values.
    """
    dtype = rows.schema[column].dataType
    links = crosswalk.filter(F.col("target_id").isNotNull()).select("source_entity", "external_reference", "target_id")
    values = rows.select(column).filter(F.col(column).isNotNull()).distinct()
    options = F.array(*[
        F.struct(F.lit(i).alias("_order"), F.lit(name).alias("source_entity"),
                 external_reference(system, schema, name, [(F.col(column), dtype)]).alias("external_reference"))
        for i, name in enumerate(sorted(entities))])
    candidates = values.select(column, F.inline(options))
    hits = live_crosswalk(candidates.join(links, ["source_entity", "external_reference"]), parent, parent_pk)
    found = first_match(hits, [column], "_order", "target_id").select(
        column, F.col("target_id").cast(parent.schema[parent_pk].dataType).alias(output))
    return spread_join(rows, found, column, "left", row_key)


def unresolved(rows: DataFrame, column: str, output: str, table: str, target_column: str) -> DataFrame:
    """Report of foreign key values that led nowhere."""
    return rows.filter(F.col(column).isNotNull() & F.col(output).isNull()).select(
        F.lit(table).alias("target_table"), F.lit(target_column).alias("target_column"),
        F.lit(column).alias("source_column"), F.col(column).cast("string").alias("source_value"))


def reconcile(
    source: DataFrame, pk: str, match: str, lookup: DataFrame, lookup_pk: str, candidates: Sequence[str],
) -> DataFrame:
    """Matches source rows to lookup rows, ignoring case, over candidate columns in order.

    Adds target_id and matched_on; both are null where nothing matches.
    """
    entries = F.array(*[
        F.struct(F.lit(i).alias("_order"), match_key(F.col(c)).alias("_key")) for i, c in enumerate(candidates)])
    keys = lookup.select(F.col(lookup_pk).alias("_id"), F.inline(entries)).filter(F.col("_key") != "")
    best = keys.groupBy("_key").agg(F.min(F.struct("_order", "_id")).alias("_best"))
    names = F.array(*[F.lit(c) for c in candidates])
    wanted = match_key(F.col(match))  # blank names match nothing: null keeps them out of one hot partition
    return source.withColumn("_key", F.when(wanted != "", wanted)).join(best, "_key", "left").withColumns({
        "target_id": F.col("_best._id"),
        "matched_on": F.get(names, F.col("_best._order")),
    }).drop("_key", "_best")


def reconciled_crosswalk(matched: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Crosswalk with the links of a reconciliation, one per key; writing them again changes nothing.

    `matched` has the crosswalk keys and `target_id`; rows without a match add nothing.
    """
    links = matched.filter(F.col("target_id").isNotNull()).groupBy(*CROSSWALK_KEY).agg(
        F.min("target_id").cast("string").alias("_id"))
    return crosswalk.join(links, list(CROSSWALK_KEY), "full_outer").withColumn(
        "target_id", F.coalesce("_id", "target_id")).select(*CROSSWALK_KEY, "target_id")


def referenced_rows(
    write_set: dict[str, DataFrame], links: Sequence[tuple[str, str, str, str]], lookups: dict[str, DataFrame],
) -> dict[str, DataFrame]:
    """Lookup rows the write set needs, and those that these need in turn, until nothing new comes.

    `links` are (child, column, parent, key) in any order; a lookup table may refer to itself. A round reads the rows that the
    round before found, so there are as many rounds as the longest chain of references has rows.
    """
    keys = {parent: key for _, _, parent, key in links}
    needed: dict[str, DataFrame] = {}
    edge = dict(write_set)
    while edge:
        hits: dict[str, list[DataFrame]] = {}
        for child, column, parent, key in links:
            if child in edge and parent not in write_set:
                hits.setdefault(parent, []).append(edge[child].select(F.col(column).alias(key)).filter(F.col(key).isNotNull()))
        edge = {}
        for parent, used in hits.items():
            key = keys[parent]
            rows = lookups[parent].join(union_all(*used).distinct(), key, "left_semi")
            rows = materialise(rows.join(needed[parent].select(key), key, "left_anti") if parent in needed else rows)
            if parent not in needed or not rows.isEmpty():
                edge[parent] = rows
                needed[parent] = union_all(needed[parent], rows) if parent in needed else rows
    return needed
