"""Queries for what goes wrong: lookups that miss, partial and bad payloads, repeated failures, stale and shared ids."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import TargetContract
from ..functions.keys import checksum, reference_for, row_json
from ..operators import drift, events, lookups, merge
from ..plans import delivery
from ..sources.workspace import materialise
from .contracts import _CHANGES, _changes
from .fixtures import (
    ACCOUNT, ACCOUNT_DETAIL, AS_OF_SQL, NATION, REMAP_SQL, SCHEMA, STRIP_SQL, SYSTEM, TARGET, as_of, crosswalk, footprints,
    keyed_customer, outbox, reference_sql, sql, table, tgt_account,
)
from .jobs import CUSTOMER, ORDER_MODEL, ORDERS, PROFILE, ROW, _state
from .registry import query

# Here an account must have a nation.
_STRICT = TargetContract((replace(ACCOUNT, columns=tuple(
    replace(c, nullable=False) if c.name == "nation_id" else c for c in ACCOUNT.columns)), ACCOUNT_DETAIL, NATION))
_HELD = "event_id bigint, errors array<string>, payload_snapshot string"
_LETTERS = ("event_id string, external_reference string, source_entity string, operation string, source_updated_at timestamp_ntz, "
            "payload_checksum string, active boolean, accepted_at timestamp_ntz")
_SWITCH = "source_entity string, target_system string, enabled boolean"


def _events(rows: DataFrame, entity: str, number: str, payload: Column) -> DataFrame:
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return rows.select(
        F.expr(number).alias("event_id"), "external_reference", F.lit(entity).alias("source_entity"),
        F.lit(TARGET).alias("target_system"), F.lit("update").alias("operation"), payload.alias("payload"),
        checksum(payload).alias("payload_checksum"), F.lit("pending").alias("status"),
        F.expr(f"CAST(({number}) % 8 AS INT)").alias("attempts"), at.alias("created_at"), at.alias("available_at"),
        at.alias("source_updated_at"), F.lit(None).cast("timestamp_ntz").alias("processed_at"),
        F.lit(None).cast("string").alias("last_error_code"), F.lit(None).cast("string").alias("last_error_message"))


def _troubled(spark: SparkSession, folder: str) -> DataFrame:
    """One event per customer: every fifth without its balance, every fifth with a word for it."""
    rows = keyed_customer(spark, folder).withColumn("c_acctbal", F.col("c_acctbal") + 3)
    whole = row_json(rows, ROW.fieldNames())
    partial = row_json(rows, [n for n in ROW.fieldNames() if n != "c_acctbal"])
    wrong = F.regexp_replace(whole, '"c_acctbal":[^,}]*', '"c_acctbal":"abc"')
    payload = F.when(F.col("c_custkey") % 5 == 0, partial).when(F.col("c_custkey") % 5 == 1, wrong).otherwise(whole)
    return _events(rows, "customer", "c_custkey", payload)


def _delivery(spark: SparkSession, folder: str) -> delivery.Delivery:
    return delivery.deliver_events(
        _troubled(spark, folder), spark.createDataFrame([("customer", TARGET, True)], _SWITCH), _state(spark, folder),
        spark.createDataFrame([], _HELD), spark.createDataFrame([], _LETTERS), CUSTOMER, _STRICT, PROFILE, SYSTEM, as_of())


_BAD = f"(c_custkey % 5 = 1 OR COALESCE({STRIP_SQL}, '') = '' OR {REMAP_SQL} = 'FURNITURE')"
_JUDGED = {"judged": f"SELECT *, CASE WHEN {_BAD} THEN 'quarantined' WHEN c_nationkey = 7 THEN CASE WHEN c_custkey % 8 = 7 THEN "
                     "'dead_letter' ELSE 'retry' END ELSE 'delivered' END AS status FROM keyed_customer"}


@query("k4_lookup_failures", sql(
    "SELECT c_custkey AS event_id, status, CAST(c_custkey % 8 + CASE WHEN status = 'quarantined' THEN 0 ELSE 1 END AS INTEGER) AS "
    "attempts, CASE WHEN status = 'quarantined' THEN 'VALIDATION' WHEN status <> 'delivered' THEN 'TRANSPORT' END AS last_error_code, "
    "CASE WHEN status IN ('retry', 'dead_letter') THEN 'required foreign key account.nation_id has no row for 7' END AS miss, "
    "COALESCE(c_custkey % 5 = 1, false) AS bad_value FROM judged", "keyed_customer", extra=_JUDGED))
def lookup_failures(spark, folder):
    done = _delivery(spark, folder).outbox
    miss = F.when(F.col("last_error_code") == "TRANSPORT", F.col("last_error_message"))
    return done.select("event_id", "status", "attempts", "last_error_code", miss.alias("miss"), F.coalesce(
        F.col("last_error_message").contains("payload value of c_acctbal is no double"), F.lit(False)).alias("bad_value"))


@query("k4_retry_audit", sql(
    "SELECT c_custkey AS event_id, CAST(c_custkey % 8 + 1 AS INTEGER) AS attempt, CASE WHEN status = 'delivered' THEN 'accepted' ELSE "
    "status END AS outcome FROM judged WHERE status <> 'quarantined'", "keyed_customer", extra=_JUDGED))
def retry_audit(spark, folder):
    return _delivery(spark, folder).audit.select("event_id", "attempt", "outcome")


@query("k4_partial_payload", sql(
    "SELECT t.id, CASE WHEN j.status = 'delivered' AND c_custkey % 5 <> 0 THEN c_acctbal + 3 ELSE t.balance END AS balance FROM "
    "tgt_account t JOIN judged j ON t.id = 1000 + j.c_custkey", "keyed_customer", "xwalk", "tgt_account", extra=_JUDGED))
def partial_payload(spark, folder):
    """An update without a balance leaves the old one; one with a word for it changes nothing."""
    known = tgt_account(spark, folder).select("id")
    return _delivery(spark, folder).target.tables["account"].join(known, "id", "left_semi").select("id", "balance")


def _followed(spark: SparkSession, folder: str) -> delivery.Delivery:
    """A whole event per customer, a later one with the name alone, and for every fourth one with the segment alone between
    them in time, whose id is the highest."""
    rows = keyed_customer(spark, folder)
    changed = rows.withColumn("c_acctbal", F.col("c_acctbal") + 3)
    renamed = rows.withColumn("c_name", F.expr("'N' || c_custkey"))
    moved = rows.filter("c_custkey % 4 = 0").withColumn("c_mktsegment", F.lit("AUTOMOBILE"))
    box = None
    for number, day, frame, names in ((0, 0, changed, ROW.fieldNames()), (1, 2, renamed, ["c_custkey", "c_name"]), (2, 1, moved, ["c_mktsegment"])):
        at = F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '{day}' DAY")
        some = _events(frame, "customer", f"c_custkey * 8 + {number}", row_json(frame, names)).withColumns(
            {"created_at": at, "source_updated_at": at, "attempts": F.lit(0)})
        box = some if box is None else box.unionByName(some)
    return delivery.deliver_events(
        box, spark.createDataFrame([("customer", TARGET, True)], _SWITCH), _state(spark, folder),
        spark.createDataFrame([], _HELD), spark.createDataFrame([], _LETTERS), CUSTOMER, TargetContract((ACCOUNT, ACCOUNT_DETAIL, NATION)),
        PROFILE, SYSTEM, as_of())


_IN_ORDER = {"rows_in_order": (
    f"SELECT c.*, t.id IS NOT NULL AS known, t.balance AS old_balance, t.segment AS old_segment, NOT (COALESCE({STRIP_SQL}, '') = '' OR "
    f"{REMAP_SQL} = 'FURNITURE') AS whole_is_good FROM keyed_customer c LEFT JOIN tgt_account t ON t.id = 1000 + c.c_custkey")}


@query("k4_folded_events", sql(
    "SELECT c_custkey, 'N' || c_custkey AS name, CASE WHEN c_custkey % 4 = 0 AND (whole_is_good OR known) THEN 'AUTO' WHEN whole_is_good "
    f"THEN {REMAP_SQL} ELSE old_segment END AS segment, CASE WHEN whole_is_good THEN c_acctbal + 3 ELSE old_balance END AS balance FROM "
    "rows_in_order", "keyed_customer", "tgt_account", extra=_IN_ORDER))
def folded_events(spark, folder):
    """Accounts after events that have some of the columns each."""
    done = _followed(spark, folder).target
    links = lookups.entity_crosswalk(done.crosswalk, "customer", TARGET, "account").withColumn("id", F.col("target_id").cast("bigint"))
    keys = keyed_customer(spark, folder).select("external_reference", "c_custkey")
    return done.tables["account"].join(links, "id").join(keys, "external_reference").select("c_custkey", "name", "segment", "balance")


@query("k4_folded_outcomes", sql(
    "SELECT c_custkey * 8 AS event_id, CASE WHEN whole_is_good THEN 'delivered' ELSE 'quarantined' END AS status FROM rows_in_order UNION "
    "ALL SELECT c_custkey * 8 + 1, 'delivered' FROM rows_in_order UNION ALL SELECT c_custkey * 8 + 2, CASE WHEN whole_is_good OR known "
    "THEN 'delivered' ELSE 'retry' END FROM rows_in_order WHERE c_custkey % 4 = 0", "keyed_customer", "tgt_account", extra=_IN_ORDER))
def folded_outcomes(spark, folder):
    """A new row that still lacks its name when an event comes has to wait, though a later event brings it."""
    return _followed(spark, folder).outbox.select("event_id", "status")


@query("k4_many_entities", sql(
    "SELECT source_entity, status, count(*) AS events FROM (SELECT 'customer' AS source_entity, CASE WHEN c_custkey % 5 = 1 OR "
    f"COALESCE({STRIP_SQL}, '') = '' OR {REMAP_SQL} = 'FURNITURE' THEN 'quarantined' ELSE 'delivered' END AS status FROM "
    "keyed_customer UNION ALL SELECT 'orders', 'delivered' FROM orders) GROUP BY ALL", "keyed_customer"))
def many_entities(spark, folder):
    """One pass over two entities, each with the mappings of an approved-mapping frame."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                                   "o_orderpriority")
    orders = orders.withColumn("external_reference", reference_for(orders, SYSTEM, SCHEMA, "orders", ["o_orderkey"]))
    box = _troubled(spark, folder).unionByName(_events(
        orders, "orders", "10000000 + o_orderkey", row_json(orders, [c for c in orders.columns if c.startswith("o_")])))
    row = orders.drop("external_reference").schema
    known = {"customer": CUSTOMER, "orders": replace(ORDERS, row_schema=row)}
    mappings = spark.createDataFrame(
        [(e.name, m.source_column, m.target_table, m.target_column, m.transform) for e in known.values() for m in e.mappings],
        "source_entity string, source_column string, target_table string, target_column string, transform string")
    model = TargetContract((ACCOUNT, ACCOUNT_DETAIL, NATION, *[t for t in ORDER_MODEL.tables if t.name != "account"]))
    state = _state(spark, folder)
    state.tables["order_head"] = spark.createDataFrame(
        [], "id bigint, account_id bigint, status string, total double, placed timestamp_ntz")
    state.tables["order_note"] = spark.createDataFrame([], "id bigint, head_id bigint, priority string")
    switch = spark.createDataFrame([("customer", TARGET, True), ("orders", TARGET, True)], _SWITCH)
    done = delivery.deliver_all(box, switch, state, spark.createDataFrame([], _HELD), spark.createDataFrame([], _LETTERS),
                                delivery.entities_of(mappings, known), model, PROFILE, SYSTEM, as_of())
    return done.outbox.groupBy("source_entity", "status").agg(F.count("*").alias("events"))


@query("d4_foreign_key_in_match", (
    f"WITH r AS (SELECT c_custkey, c_nationkey, {reference_sql('customer', 'c_custkey')} AS ref FROM customer), g AS (SELECT "
    "c_nationkey, min(ref) AS first_ref FROM r GROUP BY ALL), n AS (SELECT c_nationkey, 100 - 1 + row_number() OVER (ORDER BY "
    "first_ref) AS target_id FROM g) SELECT c_custkey, target_id FROM r JOIN n USING (c_nationkey)"))
def foreign_key_in_match(spark, folder):
    """Rows of one name in different nations are different things; in one nation they are the same."""
    rows = table(spark, folder, "customer").select("c_custkey", F.lit("Central").alias("name"), F.col("c_nationkey").alias("nation_id"))
    rows = rows.withColumn("external_reference", reference_for(rows, SYSTEM, SCHEMA, "customer", ["c_custkey"]))
    target = spark.createDataFrame([], "id bigint, name string, nation_id int")
    links = spark.createDataFrame([], "external_reference string, target_id string")
    return lookups.match_or_allocate(rows, links, target, "id", 100, ["name", "nation_id"]).select("c_custkey", "target_id")


_MANY = [f"v{k}" for k in range(70)]
# Of column k a customer gives a value where the bits of its key, scattered, say so; the last column is always given.
_GIVES = "CAST((c_custkey * 7919 + 104729) % 1000003 * ({k} + 13) % 1009 AS BIGINT) % 3 = 0"


@query("d3_many_patterns", (
    "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 4 AND c_custkey % 200 IN (SELECT s_suppkey FROM supplier) THEN c_custkey % 200 END AS target_id "
    "FROM customer"))
def many_patterns(spark, folder):
    """Seventy lookup columns, of which nearly every row gives other ones; every fifth row gives one value that disagrees."""
    lookup = table(spark, folder, "supplier").select("s_suppkey", *[
        (F.col("s_suppkey") + k if k in (0, 69) else F.col("s_suppkey") % (k + 2)).alias(c) for k, c in enumerate(_MANY)])
    of = "c_custkey % 200"
    rows = table(spark, folder, "customer").select("c_custkey", *[
        F.expr(f"CASE WHEN {_GIVES.format(k=k)} OR {k} = 69 THEN " + (f"{of} + {k}" if k in (0, 69) else f"{of} % {k + 2}")
               + (" + CASE WHEN c_custkey % 5 = 4 THEN 1000000 ELSE 0 END" if k == 69 else "") + " END").alias(c) for k, c in enumerate(_MANY)])
    return lookups.resolve_by_values(rows, _MANY, lookup, "s_suppkey").select("c_custkey", F.col("target_id").cast("bigint").alias("target_id"))


_WIDE = [f"v{k}" for k in range(20)]


@query("d3_wide_lookup", (
    "SELECT c_custkey, s_suppkey AS target_id FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 150 AND c_custkey % 4 <> 3"))
def wide_lookup(spark, folder):
    """Twenty lookup columns, of which rows give all, half, one or none."""
    lookup = table(spark, folder, "supplier").select("s_suppkey", *[(F.col("s_suppkey") + k).alias(c) for k, c in enumerate(_WIDE)])
    kind = F.col("c_custkey") % 4
    rows = table(spark, folder, "customer").select("c_custkey", *[
        F.when((kind == 0) | ((kind == 1) & F.lit(k < 10)) | ((kind == 2) & F.lit(k == 17)), F.col("c_custkey") % 150 + k).alias(c)
        for k, c in enumerate(_WIDE)])
    return lookups.resolve_by_values(rows, _WIDE, lookup, "s_suppkey").select("c_custkey", "target_id")


@query("d5_stale_and_shared", sql(
    "SELECT c_custkey, CASE WHEN live THEN 1000 + c_custkey ELSE c_custkey // 2 END AS target_id, CASE WHEN rn > 1 THEN 'match' WHEN "
    "live THEN 'update' ELSE 'insert' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN live THEN 1000 + "
    "c_custkey ELSE c_custkey // 2 END ORDER BY external_reference DESC) AS rn FROM (SELECT c.c_custkey, c.external_reference, t.id IS "
    "NOT NULL AS live FROM keyed_customer c LEFT JOIN tgt_account t ON t.id = 1000 + c.c_custkey))", "keyed_customer", "xwalk",
    "tgt_account"))
def stale_and_shared(spark, folder):
    """A recorded id that is gone from the target does not count; of rows with one id one writes."""
    rows = keyed_customer(spark, folder).selectExpr("c_custkey", "external_reference", "CAST(c_custkey DIV 2 AS BIGINT) AS id")
    links = lookups.entity_crosswalk(crosswalk(spark, folder), "customer", TARGET, "account")
    return lookups.carried_ids(rows, links, "id", tgt_account(spark, folder)).select(
        "c_custkey", F.col("target_id").cast("bigint").alias("target_id"), "action")


@query("a12_only_lookups", sql(
    "SELECT 'kept' AS part, count(*) AS rows FROM nation UNION ALL SELECT 'links', count(*) FROM xwalk UNION ALL SELECT 'deleted', 0",
    "xwalk"))
def only_lookups(spark, folder):
    left, links, deleted = merge.scoped_delete({"nation": (table(spark, folder, "nation"), "n_nationkey")}, crosswalk(spark, folder),
                                               "customer", TARGET, ["nation"])
    parts = {"kept": left["nation"], "links": links, "deleted": deleted}
    rows = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("part"), "rows") for n, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("h3_repeated_failure", sql(
    "SELECT event_id, CAST(attempts + 1 AS INTEGER) AS attempts, CASE WHEN attempts + 1 >= 8 THEN 'dead_letter' ELSE 'retry' END AS "
    "status, 'reset; timeout' AS last_error_message FROM outbox_base WHERE event_id % 3 = 0", "outbox_base"))
def repeated_failure(spark, folder):
    """Two failures of an event in one pass are one attempt."""
    box = outbox(spark, folder)
    hits = box.filter("event_id % 3 = 0").select("event_id", F.explode(F.array(F.lit("timeout"), F.lit("reset"))).alias("error"))
    return events.fail(box, hits, as_of()).filter("event_id % 3 = 0").select("event_id", "attempts", "status", "last_error_message")


_PAYLOAD_SQL = ("'{\"c_custkey\":' || c_custkey || ',\"c_nationkey\":' || c_nationkey || ',\"external_reference\":\"' || "
                "external_reference || '\"}'")


@query("g1_backfill_events", sql(
    f"SELECT external_reference, 'backfill' AS operation, 'pending' AS status, {_PAYLOAD_SQL} AS payload, sha256({_PAYLOAD_SQL}) AS "
    f"payload_checksum, {AS_OF_SQL} AS available_at FROM keyed_customer WHERE external_reference NOT IN (SELECT external_reference "
    "FROM xwalk)", "keyed_customer", "xwalk"))
def backfill_events(spark, folder):
    found = merge.backfill_events(keyed_customer(spark, folder), crosswalk(spark, folder), "customer", TARGET,
                                  ["c_custkey", "c_nationkey"], as_of())
    return found.select("external_reference", "operation", "status", "payload", "payload_checksum", "available_at")


@query("d9_crosswalk_write", sql(
    f"SELECT {reference_sql('customer', 'c_custkey')} AS external_reference, CAST(n_nationkey AS VARCHAR) AS target_id FROM customer JOIN "
    "nation ON n_nationkey = c_nationkey"))
def crosswalk_write(spark, folder):
    """Links found by name, written twice: the second time changes nothing."""
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    places = table(spark, folder, "customer").join(
        nations.select(F.col("n_nationkey").alias("c_nationkey"), F.lower("n_name").alias("place")), "c_nationkey")
    places = places.select("c_custkey", "place").withColumn("external_reference", reference_for(
        places.select("c_custkey"), SYSTEM, SCHEMA, "customer", ["c_custkey"]))
    found = lookups.reconcile(places, "c_custkey", "place", nations, "n_nationkey", ["n_name"]).withColumns({
        "source_system": F.lit(SYSTEM), "source_entity": F.lit("customer"), "target_system": F.lit(TARGET),
        "target_table": F.lit("nation")})
    none = crosswalk(spark, folder).limit(0)
    once = materialise(lookups.reconciled_crosswalk(found, none))
    return lookups.reconciled_crosswalk(found, once).select("external_reference", "target_id")


@query("i4_drift_report", sql(
    "SELECT 'source-target' AS drift_pair, (SELECT string_agg(table_name || '.' || COALESCE(column_name, '*') || ' ' || kind, '; ' ORDER "
    "BY table_name || '.' || COALESCE(column_name, '*') || ' ' || kind) FROM changes) AS differences, (SELECT count(DISTINCT "
    "source_entity) FROM footprints WHERE table_name IN (SELECT table_name FROM changes WHERE breaking)) AS impacted, (SELECT "
    "bool_or(breaking) FROM changes) AS breaking", "catalog_v1", "catalog_v2", "footprints", extra=_CHANGES))
def drift_report(spark, folder):
    changes = _changes(spark, folder)
    report = drift.drift_report(changes, drift.impacted_by_breaking(changes, footprints(spark, folder)), "source-target",
                                F.lit("abcdef"), as_of())
    shown = F.transform("differences", lambda d: F.concat(
        d["table_name"], F.lit("."), F.coalesce(d["column_name"], F.lit("*")), F.lit(" "), d["kind"]))
    return report.select("drift_pair", F.array_join(F.array_sort(shown), "; ").alias("differences"),
                         F.size("impacted_entities").cast("bigint").alias("impacted"), "breaking")
