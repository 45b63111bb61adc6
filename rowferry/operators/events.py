"""Outbox state: each function takes the outbox and returns its next content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import upsert_last
from .ordering import oldest

# Fixed values of the retry policy.
MAX_ATTEMPTS = 8
MESSAGE_LENGTH = 2000
REPLAYABLE = ("quarantined", "dead_letter", "delivered")


def claimable(outbox: DataFrame, control: DataFrame, as_of: Column) -> DataFrame:
    """Due events of enabled entities. The control table is one row per entity.

    It is sent to the events, as events dealt by entity would be one task per entity.
    """
    enabled = control.filter(F.col("enabled")).select("source_entity", "target_system")
    due = outbox.filter(F.col("status").isin("pending", "retry") & (F.col("available_at") <= as_of))
    return due.join(F.broadcast(enabled), ["source_entity", "target_system"])


def claim(outbox: DataFrame, control: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Marks claimable events as processing, the oldest `limit` of them when a limit is given."""
    ready = claimable(outbox, control, as_of)
    if limit is not None:
        ready = oldest(ready, "created_at", "event_id", limit)
    return _mark(outbox, ready.select("event_id"), {"status": lambda: F.lit("processing")})


def _mark(outbox: DataFrame, hits: DataFrame, changes: dict) -> DataFrame:
    flagged = outbox.join(hits.distinct().withColumn("_hit", F.lit(True)), "event_id", "left")
    updated = {name: F.when(F.col("_hit"), make()).otherwise(F.col(name)) for name, make in changes.items()}
    return flagged.withColumns(updated).drop("_hit").select(*outbox.columns)


def mark_delivered(outbox: DataFrame, done: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(outbox, audit rows): status delivered, one attempt more, errors cleared."""
    attempt = F.col("attempts") + 1
    audit = outbox.join(done.select("event_id"), "event_id", "left_semi").select(
        "event_id", attempt.alias("attempt"), F.lit("accepted").alias("outcome"), F.lit("UPSERTED").alias("response_code"))
    after = _mark(outbox, done.select("event_id"), {
        "status": lambda: F.lit("delivered"), "attempts": lambda: attempt, "processed_at": lambda: as_of,
        "last_error_code": lambda: F.lit(None), "last_error_message": lambda: F.lit(None)})
    return after, audit


def record_crosswalk(crosswalk: DataFrame, delivered: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Crosswalk upsert that keeps the recorded id when the new one is null."""
    incoming = delivered.select(*keys, F.col("target_id").alias("_id"))
    return crosswalk.join(incoming, list(keys), "full_outer").withColumn(
        "target_id", F.coalesce("_id", "target_id")).drop("_id").select(*keys, "target_id")


def backoff_seconds(attempt: Column) -> Column:
    """Fixed rule: fifteen seconds doubled per attempt, ten doublings and one hour at most."""
    return F.least(F.lit(3600), (15 * F.pow(F.lit(2), F.least(attempt, F.lit(10)))).cast("int"))


def fail(outbox: DataFrame, failures: DataFrame, as_of: Column, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """Retry with back-off, or dead letter after the last attempt. `failures` is (event_id, error).

    An event that failed more than once in one pass has one attempt more, with its errors joined.
    """
    hits = failures.groupBy("event_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.coalesce("error", F.lit("")))), "; ").alias("_error"))
    hit = F.col("_error").isNotNull()
    attempt = F.col("attempts") + 1
    terminal = attempt >= limit
    wait = F.make_dt_interval(secs=backoff_seconds(attempt))
    return outbox.join(hits, "event_id", "left").withColumns({
        "status": F.when(hit, F.when(terminal, "dead_letter").otherwise("retry")).otherwise(F.col("status")),
        "available_at": F.when(hit, as_of + wait).otherwise(F.col("available_at")),
        "processed_at": F.when(hit, F.when(terminal, as_of)).otherwise(F.col("processed_at")),
        "last_error_code": F.when(hit, "TRANSPORT").otherwise(F.col("last_error_code")),
        "last_error_message": F.when(hit, F.left("_error", F.lit(MESSAGE_LENGTH)))
        .otherwise(F.col("last_error_message")),
        "attempts": F.when(hit, attempt).otherwise(F.col("attempts")),
    }).select(*outbox.columns)


def failed_attempts(outbox: DataFrame, failures: DataFrame, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """Audit rows of failed attempts, one per event."""
    attempt = F.col("attempts") + 1
    return outbox.join(failures.select("event_id").distinct(), "event_id", "left_semi").select(
        "event_id", attempt.alias("attempt"), F.when(attempt >= limit, "dead_letter").otherwise("retry").alias("outcome"),
        F.lit("TRANSPORT").alias("response_code"))


def replay(
    outbox: DataFrame, quarantine: DataFrame, wanted: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outbox, quarantine, rejected): finished events go back to pending with no attempts."""
    asked = outbox.join(wanted.select("event_id"), "event_id", "left_semi")
    allowed = asked.filter(F.col("status").isin(*REPLAYABLE)).select("event_id")
    rejected = wanted.select("event_id").join(allowed, "event_id", "left_anti")
    after = _mark(outbox, allowed, {
        "status": lambda: F.lit("pending"), "attempts": lambda: F.lit(0), "available_at": lambda: as_of,
        "processed_at": lambda: F.lit(None), "last_error_code": lambda: F.lit(None),
        "last_error_message": lambda: F.lit(None)})
    return after, quarantine.join(allowed, "event_id", "left_anti"), rejected


def cancel_pending(outbox: DataFrame, entity: str) -> DataFrame:
    """Sets all pending events of an entity aside."""
    hit = (F.col("source_entity") == entity) & (F.col("status") == "pending")
    return outbox.withColumns({
        "status": F.when(hit, "quarantined").otherwise(F.col("status")),
        "last_error_message": F.when(hit, F.concat(
            F.coalesce(F.concat("last_error_message", F.lit("\n")), F.lit("")), F.lit("cancelled by admin")))
        .otherwise(F.col("last_error_message")),
    })


def envelope(events: DataFrame, accepted_at: Column) -> DataFrame:
    """Delivery envelope of accepted events; a deactivation only clears the active flag."""
    return events.select(
        F.col("event_id").cast("string").alias("event_id"), "external_reference", "source_entity", "operation",
        "source_updated_at", "payload_checksum", (F.col("operation") != "deactivate").alias("active"),
        accepted_at.alias("accepted_at"))


def upsert_envelope(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert_last(current, incoming, ["event_id"])


def latest_mapping(reviews: DataFrame, proposals: DataFrame, staging_pattern: str) -> DataFrame:
    """Usable field mappings of the newest approved proposal of each entity.

    Only a proposal with at least one accepted mapping onto a real target table counts; resolved
    values override suggested ones.
    """
    accepted = reviews.filter(F.col("status").isin("accepted", "resolved"))
    real = F.col("suggested_target_table").isNotNull() & ~F.col("suggested_target_table").rlike(staging_pattern)
    usable = accepted.filter(real)
    approved = proposals.filter(F.col("status").isin("approved", "auto_approved")).select("source_entity", "proposal_id")
    # usable keeps one row per proposal, so the newest proposal is a plain maximum.
    newest = approved.join(usable.select("proposal_id").distinct(), "proposal_id", "left_semi") \
        .groupBy("source_entity").agg(F.max("proposal_id").alias("proposal_id"))
    return usable.join(newest, "proposal_id").select(
        "source_entity", "source_column", F.col("suggested_target_table").alias("target_table"),
        _first_filled("resolved_target_column", "suggested_target_column").alias("target_column"),
        F.coalesce(_first_filled("resolved_transform", "transform"), F.lit("none")).alias("transform"),
    ).filter(F.col("target_column").isNotNull())


def _first_filled(*names: str) -> Column:
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])


def quarantine_listing(quarantine: DataFrame, outbox: DataFrame, limit: int, resolved: bool = False) -> DataFrame:
    """Newest quarantined events with their outbox fields."""
    chosen = quarantine if resolved else quarantine.filter(F.col("resolved_at").isNull())
    fields = outbox.select("event_id", "source_entity", F.col("status").alias("outbox_status"), "attempts",
                           "operation", "external_reference")
    return chosen.join(fields, "event_id").orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(limit)
