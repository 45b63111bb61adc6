"""Reading error texts, finding ownership conflicts, planning and applying safe repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import uuid5
from ..functions.text import substrings
from .lookups import CROSSWALK_KEY

# Message formats of the target engines and of the delivery itself.
DUPLICATE_POSTGRES = r'(?is)unique constraint "(\w+)_pkey".*?key \((\w+)\)=\(([^)]+)\) already exists'
DUPLICATE_MYSQL = r"(?i)duplicate entry '([^']+)' for key '(?:\w+\.)?(?:PRIMARY|(\w+)_pkey)'"
NO_REFERENCE_MATCH = r"(?i)no row in reference table\s+(\w+)\s+matches\s+\{\s*'([^']*)'\s*:\s*'?([^,}']*)'?[^}]*\}"
READ_ONLY_MISSING = r"(?i)(\w+)\.(\w+)=(?:'([^']+)'|([^;\s]+)) does not exist;\s*\1 is read-only"
REQUIRED_UNMAPPED = r"(?i)-\s*(\w+)\.(\w+)\s+is required but no source column maps to it"
YEAR_OUT_OF_RANGE = r"(?i)(\w+)\.(\w+) date year ([0-9]+) is outside supported range"
JOB_ID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
# Reasons against a repair, and advice for an entity.
COMPOSITE_KEY = "no_single_key"
TARGET_GONE = "target_row_gone"
CLAIMED = "id_of_another_row"
REPAIRED = "crosswalk_repaired"
ADVICE = {
    "paused": "entity_paused",
    "bare": "no_target_tables",
    "empty": "targets_empty",
    "failed": "last_job_failed",
    "fine": "nothing_in_the_way",
}


def _group(text: Column, pattern: str, index: int) -> Column:
    found = F.regexp_extract(text, pattern, index)
    return F.when(found != "", found)


def classify(errors: DataFrame, text: str = "error") -> DataFrame:
    """Adds category, target_table, target_column, target_id, detail and job_id to an error log."""
    t = F.col(text)

    def one(name: str, table: Column, column: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("category"), table.alias("target_table"),
                        column.alias("target_column"), value.alias("target_id"))

    def by(name: str, pattern: str, *more: Column) -> Column:
        value = _group(t, pattern, 3) if not more else F.coalesce(_group(t, pattern, 3), *more)
        return one(name, _group(t, pattern, 1), _group(t, pattern, 2), value)

    nothing = F.lit(None).cast("string")
    found = F.when(t.rlike(DUPLICATE_POSTGRES), by("duplicate_key", DUPLICATE_POSTGRES)) \
        .when(t.rlike(DUPLICATE_MYSQL), one("duplicate_key", _group(t, DUPLICATE_MYSQL, 2), F.lit("id"),
                                            _group(t, DUPLICATE_MYSQL, 1))) \
        .when(t.rlike(NO_REFERENCE_MATCH), by("reference_match_missing", NO_REFERENCE_MATCH)) \
        .when(t.rlike(READ_ONLY_MISSING), by("read_only_reference_missing", READ_ONLY_MISSING,
                                             _group(t, READ_ONLY_MISSING, 4))) \
        .when(t.rlike(REQUIRED_UNMAPPED), one("missing_required_mapping", _group(t, REQUIRED_UNMAPPED, 1),
                                              _group(t, REQUIRED_UNMAPPED, 2), nothing)) \
        .when(t.rlike(YEAR_OUT_OF_RANGE), by("data_quality", YEAR_OUT_OF_RANGE)) \
        .otherwise(one("unknown", nothing, nothing, nothing))
    pairs = F.when(F.col("_found.category") == "missing_required_mapping", REQUIRED_UNMAPPED)
    listed = F.when(pairs.isNotNull(), F.arrays_zip(
        F.regexp_extract_all(t, F.lit(REQUIRED_UNMAPPED), 1).alias("t"),
        F.regexp_extract_all(t, F.lit(REQUIRED_UNMAPPED), 2).alias("c")))
    detail = F.transform(listed, lambda p: F.concat(p["t"], F.lit("."), p["c"]))
    return errors.withColumn("_found", found).select(
        *errors.columns, "_found.*", detail.alias("detail"), _group(t, JOB_ID, 0).alias("job_id"))


def ownership_conflicts(crosswalk: DataFrame) -> DataFrame:
    """Target ids claimed by more than one source row."""
    target = ["target_system", "target_table", "target_id"]
    claims = crosswalk.filter(F.col("target_id").isNotNull()) \
        .select(*target, "source_entity", "external_reference").distinct()
    return claims.groupBy(*target).agg(F.count("*").alias("owners")).filter(F.col("owners") > 1)


def repair_plan(
    errors: DataFrame, entities: DataFrame, targets: DataFrame, crosswalk: DataFrame,
) -> DataFrame:
    """For duplicate-key errors: the crosswalk row to add, or why it is not safe to add one.

    `errors` is (error_id, source_entity, target_table, target_id) from `classify`; `entities` has
    source_system, source_schema, primary_key (array) and mapped_column per entity and target table;
    `targets` is (target_table, target_id) of existing target rows.
    """
    known = errors.join(entities, ["source_entity", "target_table"], "left")
    single = F.size("primary_key") == 1
    from_key = single & F.col("mapped_column").eqNullSafe(F.get("primary_key", F.lit(0)))
    reference = _reference_of_target_id()
    prepared = known.withColumn("external_reference", F.when(from_key, reference)) \
        .join(targets.select("target_table", "target_id").distinct().withColumn("_there", F.lit(True)),
              ["target_table", "target_id"], "left")
    # Owners are reduced to a few facts per target id, so a much-claimed id stays one row.
    owners = crosswalk.filter(F.col("target_id").isNotNull()).groupBy("target_table", "target_id").agg(
        F.min(F.struct("source_entity", "external_reference")).alias("_low"),
        F.max(F.struct("source_entity", "external_reference")).alias("_high"),
        F.min("source_entity").alias("_first"), F.max("source_entity").alias("_last"))
    joined = prepared.join(owners, ["target_table", "target_id"], "left")
    mine = F.struct("source_entity", "external_reference")
    foreign = F.col("_low").isNotNull() & F.when(
        F.col("external_reference").isNull(),
        (F.col("_first") != F.col("source_entity")) | (F.col("_last") != F.col("source_entity")),
    ).otherwise((F.col("_low") != mine) | (F.col("_high") != mine))
    reasons = F.filter(F.array(
        F.when(~F.coalesce(single, F.lit(False)), COMPOSITE_KEY),
        F.when(single & ~from_key, F.concat(
            F.lit("not_mapped_from_key:"), F.coalesce("mapped_column", F.lit("")))),
        F.when(F.col("_there").isNull(), TARGET_GONE),
        F.when(foreign, CLAIMED),
    ), lambda r: r.isNotNull())
    return joined.withColumn("reasons", reasons).select(
        "error_id", "source_system", "source_entity", "target_table", "target_id", "external_reference",
        (F.size("reasons") == 0).alias("safe_to_repair"), "reasons")


def apply_repairs(
    plan: DataFrame, crosswalk: DataFrame, target_system: str, actor: str, at: Column,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The crosswalk with all safe repairs of a plan recorded, one audit row for each, and the plan with what became of it.

    Repeated errors of one row are one repair. Rows that are each safe but claim the same target id cannot all have it:
    the row with the first error gets it, as if the errors were repaired one after another, and the others are refused.
    A crosswalk row that is there already gets the id and the time and keeps its other columns.
    """
    target, row = ["target_table", "target_id"], ["source_system", "source_entity", "external_reference"]
    first = plan.filter("safe_to_repair").groupBy(*target).agg(F.min(F.struct("error_id", *row)).alias("_first"))
    repairs = first.select(*target, *[F.col(f"_first.{c}").alias(c) for c in row])
    new = repairs.select(
        *row, F.lit(target_system).alias("target_system"), "target_table", F.col("target_id").alias("_id"), at.alias("_at"))
    renewed = crosswalk.join(new, list(CROSSWALK_KEY), "full_outer") \
        .withColumns({"target_id": F.coalesce("_id", "target_id"), "updated_at": F.coalesce("_at", "updated_at")})
    audit = repairs.select(
        "source_entity", F.lit(REPAIRED).alias("action"),
        F.to_json(F.struct("external_reference", "target_id", "target_table")).alias("details"),
        F.lit(actor).alias("performed_by"), at.alias("performed_at"))
    done = plan.join(repairs.withColumn("_done", F.lit(True)), [*target, *row], "left")
    applied = F.col("safe_to_repair") & F.col("_done").isNotNull()
    outcome = done.select(*plan.columns[:-1], F.when(F.col("safe_to_repair") & ~applied, F.array(F.lit(CLAIMED)))
                          .otherwise(F.col("reasons")).alias("reasons"), applied.alias("applied"))
    return renewed.select(*crosswalk.columns), audit, outcome


def _reference_of_target_id() -> Column:
    """Reference a source row has when its key equals the target id of the error."""
    return uuid5(F.concat_ws("|", "source_system", "source_schema", "source_entity", "target_id"))


def _one_blank(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", " "))


def last_job_per_entity(jobs: DataFrame, entities: DataFrame) -> DataFrame:
    """Newest job whose text names the entity.

    `jobs` is (job_id, created_at, text). Runs of as many words as the longest name has keep only their newest job,
    and they meet entity names through their substrings, so no entity is ever compared with every job. White space
    counts as one blank in names and texts; any other character of a name has to stand in the text.
    """
    named = entities.select("source_entity", _one_blank(F.col("source_entity")).alias("_name"))
    sizes = named.agg(F.greatest(F.max(F.length("_name")), F.lit(1)).alias("_longest"),
                      F.greatest(F.max(F.size(F.split("_name", " "))), F.lit(1)).alias("_words"))
    longest, in_name = sizes.select("_longest").scalar(), sizes.select("_words").scalar()
    split = jobs.select(F.struct("created_at", "job_id").alias("_job"), F.split(_one_blank(F.col("text")), " ").alias("_all")) \
        .withColumn("_words", in_name)
    runs = F.transform("_all", lambda _, at: F.array_join(F.slice("_all", at + 1, F.col("_words")), " "))
    words = split.select("_job", F.explode(F.array_distinct(runs)).alias("_word")).filter(F.col("_word") != "")
    newest = words.groupBy("_word").agg(F.max("_job").alias("_job"))
    pieces = newest.withColumn("_longest", longest).select(
        "_job", F.explode(substrings(F.col("_word"), F.col("_longest"))).alias("_name"))
    return named.join(pieces, "_name").groupBy("source_entity").agg(F.max("_job").alias("_job")) \
        .select("source_entity", F.col("_job.job_id").alias("job_id"))


def delivery_diagnosis(
    entities: DataFrame, control: DataFrame, proposals: DataFrame, crosswalk: DataFrame,
    target_counts: DataFrame, jobs: DataFrame, failures: DataFrame,
) -> DataFrame:
    """One row per entity: state, newest proposal, counts, last job and what to do next."""
    newest = proposals.groupBy("source_entity").agg(
        F.max(F.struct("created_at", "proposal_id", "status")).alias("_p"))
    linked = crosswalk.groupBy("source_entity").agg(F.count("*").alias("crosswalk_rows"))
    tables = entities.select("source_entity", F.explode("target_tables").alias("target_table"))
    counts = tables.join(target_counts, "target_table", "left").groupBy("source_entity").agg(
        F.sum(F.coalesce("rows", F.lit(0))).alias("target_rows"))
    last = last_job_per_entity(jobs, entities)
    failed = failures.groupBy("job_id").agg(F.count("*").alias("job_failures"))
    joined = entities.join(control.select("source_entity", "enabled"), "source_entity", "left") \
        .join(newest, "source_entity", "left").join(linked, "source_entity", "left") \
        .join(counts, "source_entity", "left").join(last, "source_entity", "left").join(failed, "job_id", "left")
    no_tables = F.size("target_tables") == 0
    advice = F.filter(F.array(
        F.when(F.col("status") == "paused", ADVICE["paused"]),
        F.when(no_tables, ADVICE["bare"]),
        F.when(~no_tables & (F.coalesce("target_rows", F.lit(0)) == 0), ADVICE["empty"]),
        F.when(F.col("job_failures") > 0, ADVICE["failed"]),
    ), lambda r: r.isNotNull())
    fine = F.array(F.lit(ADVICE["fine"]))
    return joined.withColumn("_advice", advice).select(
        "source_entity", "status", F.col("enabled").alias("control_enabled"),
        F.col("_p.proposal_id").alias("latest_proposal_id"), F.col("_p.status").alias("latest_proposal_status"),
        F.coalesce("crosswalk_rows", F.lit(0)).alias("crosswalk_rows"),
        F.coalesce("target_rows", F.lit(0)).alias("target_rows"), F.col("job_id").alias("latest_job"),
        F.when(F.size("_advice") > 0, F.col("_advice")).otherwise(fine).alias("recommendations"))
