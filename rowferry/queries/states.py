"""Outbox state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events, merge
from .fixtures import AS_OF_SQL, as_of, control, fixture, outbox, sql, table
from .registry import query

_STATE = ("event_id", "status", "attempts", "available_at", "processed_at", "last_error_code", "last_error_message")


@query("h1_claim", sql(
    "SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM outbox JOIN control USING (source_entity, target_system) WHERE "
    f"enabled AND status IN ('pending', 'retry') AND available_at <= {AS_OF_SQL} ORDER BY created_at, event_id LIMIT 100) THEN "
    "'processing' ELSE status END AS status FROM outbox", "outbox", "control"))
def claim(spark, folder):
    return events.claim(outbox(spark, folder), control(spark, folder), as_of(), 100).select("event_id", "status")


_DONE = "status = 'processing' AND event_id % 4 <> 0"


@query("h2_mark_delivered", sql(
    f"SELECT event_id, CASE WHEN {_DONE} THEN 'delivered' ELSE status END AS status, CASE WHEN {_DONE} THEN attempts + 1 ELSE "
    f"attempts END AS attempts, available_at, CASE WHEN {_DONE} THEN {AS_OF_SQL} ELSE processed_at END AS processed_at, CASE WHEN "
    f"NOT ({_DONE}) THEN last_error_code END AS last_error_code, CASE WHEN NOT ({_DONE}) THEN last_error_message END AS "
    "last_error_message FROM outbox", "outbox"))
def mark_delivered(spark, folder):
    box = outbox(spark, folder)
    return events.mark_delivered(box, box.filter(_DONE), as_of())[0].select(*_STATE)


@query("h2_delivery_audit", sql(
    f"SELECT event_id, attempts + 1 AS attempt, 'accepted' AS outcome, 'UPSERTED' AS response_code FROM outbox WHERE {_DONE}",
    "outbox"))
def delivery_audit(spark, folder):
    box = outbox(spark, folder)
    return events.mark_delivered(box, box.filter(_DONE), as_of())[1]


@query("h2_crosswalk_upsert", (
    "SELECT o_custkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'new' ELSE CASE WHEN o_custkey % 3 = 0 THEN 'old' END END AS target_id "
    "FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey % 3 = 0 AND "
    "c_custkey NOT IN (SELECT o_custkey FROM orders)"))
def crosswalk_upsert(spark, folder):
    known = table(spark, folder, "customer").filter("c_custkey % 3 = 0").selectExpr("c_custkey AS k", "'old' AS target_id")
    done = table(spark, folder, "orders").select("o_custkey").distinct().selectExpr(
        "o_custkey AS k", "CASE WHEN o_custkey % 2 = 0 THEN 'new' END AS target_id")
    return events.record_crosswalk(known, done, ("k",))


_BAD = "status = 'processing'"


@query("h3_retry_or_dead_letter", sql(
    f"SELECT event_id, CASE WHEN {_BAD} THEN CASE WHEN attempts + 1 >= 8 THEN 'dead_letter' ELSE 'retry' END ELSE status END AS "
    f"status, CASE WHEN {_BAD} THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN {_BAD} THEN {AS_OF_SQL} + "
    "to_seconds(CAST(least(3600, 15 * power(2, least(attempts + 1, 10))) AS BIGINT)) ELSE available_at END AS available_at, CASE "
    f"WHEN {_BAD} THEN CASE WHEN attempts + 1 >= 8 THEN {AS_OF_SQL} END ELSE processed_at END AS processed_at, CASE WHEN {_BAD} "
    f"THEN 'TRANSPORT' ELSE last_error_code END AS last_error_code, CASE WHEN {_BAD} THEN substr(repeat(payload, 300), 1, 2000) "
    "ELSE last_error_message END AS last_error_message FROM outbox", "outbox"))
def retry_or_dead_letter(spark, folder):
    box = outbox(spark, folder)
    failures = box.filter(_BAD).select("event_id", F.repeat("payload", F.lit(300)).alias("error"))
    return events.fail(box, failures, as_of()).select(*_STATE)


_WANTED = "event_id % 7 < 3"
_AGAIN = f"{_WANTED} AND status IN ('quarantined', 'dead_letter', 'delivered')"


def _replayed(spark, folder):
    box = outbox(spark, folder)
    held = box.filter("status = 'quarantined'").select("event_id")
    return events.replay(box, held, box.filter(_WANTED), as_of())


@query("h4_replay", sql(
    f"SELECT event_id, CASE WHEN {_AGAIN} THEN 'pending' ELSE status END AS status, CASE WHEN {_AGAIN} THEN 0 ELSE attempts END AS "
    f"attempts, CASE WHEN {_AGAIN} THEN {AS_OF_SQL} ELSE available_at END AS available_at, CASE WHEN NOT ({_AGAIN}) THEN "
    f"processed_at END AS processed_at, CASE WHEN NOT ({_AGAIN}) THEN last_error_code END AS last_error_code, CASE WHEN NOT "
    f"({_AGAIN}) THEN last_error_message END AS last_error_message FROM outbox", "outbox"))
def replay(spark, folder):
    return _replayed(spark, folder)[0].select(*_STATE)


@query("h4_replay_leftovers", sql(
    f"SELECT event_id, 'quarantined' AS part FROM outbox WHERE status = 'quarantined' AND NOT ({_WANTED}) UNION ALL SELECT "
    f"event_id, 'rejected' FROM outbox WHERE {_WANTED} AND status NOT IN ('quarantined', 'dead_letter', 'delivered')", "outbox"))
def replay_leftovers(spark, folder):
    _, held, rejected = _replayed(spark, folder)
    return held.select("event_id", F.lit("quarantined").alias("part")).unionByName(
        rejected.select("event_id", F.lit("rejected").alias("part")))


@query("h5_cancel_pending", sql(
    "SELECT event_id, CASE WHEN source_entity = 'view' AND status = 'pending' THEN 'quarantined' ELSE status END AS status, CASE "
    "WHEN source_entity = 'view' AND status = 'pending' THEN COALESCE(last_error_message || chr(10), '') || 'cancelled by admin' "
    "ELSE last_error_message END AS last_error_message FROM outbox", "outbox"))
def cancel_pending(spark, folder):
    return events.cancel_pending(outbox(spark, folder), "view").select("event_id", "status", "last_error_message")


_REVIEWS = ("CAST(floor(p_partkey / 4) AS BIGINT) AS proposal_id", "'src_' || CAST(p_partkey % 4 AS STRING) AS source_column",
            "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'old_x_staging' ELSE 'account' END AS suggested_target_table",
            "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'col_' || CAST(p_partkey % 5 AS STRING) END AS suggested_target_column",
            "CASE WHEN p_size > 30 THEN 'resolved_col' WHEN p_size > 25 THEN '' END AS resolved_target_column",
            "CASE WHEN p_size % 3 = 0 THEN 'trim' END AS transform",
            "CASE WHEN p_size % 5 = 0 THEN 'none' END AS resolved_transform",
            "CASE p_partkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'resolved' WHEN 2 THEN 'rejected' ELSE 'accepted' END AS status")
_PROPOSED = ("CAST(floor(p_partkey / 4) AS BIGINT) AS proposal_id",
             "'ent_' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) AS source_entity",
             "CASE CAST(floor(p_partkey / 4) AS BIGINT) % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'auto_approved' ELSE 'superseded' "
             "END AS status")


@query("h8_latest_mapping", sql(
    "SELECT n.source_entity, source_column, suggested_target_table AS target_table, COALESCE(nullif(resolved_target_column, ''), "
    "suggested_target_column) AS target_column, COALESCE(resolved_transform, transform, 'none') AS transform FROM usable u JOIN "
    "newest n USING (proposal_id) WHERE COALESCE(nullif(resolved_target_column, ''), suggested_target_column) IS NOT NULL",
    extra={"reviews": f"SELECT {', '.join(_REVIEWS)} FROM part",
           "proposed": f"SELECT DISTINCT {', '.join(_PROPOSED)} FROM part",
           "usable": "SELECT * FROM reviews WHERE status IN ('accepted', 'resolved') AND suggested_target_table IS NOT NULL AND "
                     "suggested_target_table NOT LIKE 'old_%_staging'",
           "newest": "SELECT source_entity, max(proposal_id) AS proposal_id FROM proposed WHERE status <> 'superseded' AND "
                     "proposal_id IN (SELECT proposal_id FROM usable) GROUP BY 1"}))
def latest_mapping(spark, folder):
    part = table(spark, folder, "part")
    return events.latest_mapping(part.selectExpr(*_REVIEWS), part.selectExpr(*_PROPOSED).distinct(), "^old_.*_staging$")


@query("h9_soft_delete", sql(
    "SELECT event_id, operation, operation <> 'deactivate' AS active FROM outbox_base", "outbox_base"))
def soft_delete(spark, folder):
    return merge.soft_delete(fixture(spark, folder, "outbox_base").select("event_id", "operation"))


@query("h10_delivery_envelope", sql(
    "SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN status = 'delivered' THEN operation <> 'deactivate' ELSE true END AS "
    f"active, CASE WHEN status = 'delivered' THEN {AS_OF_SQL} ELSE created_at END AS accepted_at, sha256(payload) AS "
    "payload_checksum FROM outbox WHERE status = 'delivered' OR event_id % 5 = 0", "outbox"))
def delivery_envelope(spark, folder):
    box = outbox(spark, folder).withColumn("payload_checksum", F.sha2("payload", 256))
    before = events.envelope(box.filter("event_id % 5 = 0"), F.col("created_at")).withColumn("active", F.lit(True))
    after = events.upsert_envelope(before, events.envelope(box.filter("status = 'delivered'"), as_of()))
    return after.select("event_id", "active", "accepted_at", "payload_checksum")
