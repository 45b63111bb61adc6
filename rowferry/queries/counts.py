"""Counts, summaries, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnose, metrics, ordering
from .fixtures import crosswalk, fixture, keyed_customer, sql, table
from .registry import query


@query("e1_queue_by_entity", sql(
    "SELECT source_entity, status, count(*) AS events, min(created_at) AS oldest FROM outbox_base GROUP BY 1, 2", "outbox_base"))
def queue_by_entity(spark, folder):
    return metrics.queue_by_entity(fixture(spark, folder, "outbox_base"))


@query("e2_queue_by_status", sql(
    "SELECT status, count(*) AS events, min(created_at) AS oldest FROM outbox_base GROUP BY 1", "outbox_base"))
def queue_by_status(spark, folder):
    return metrics.queue_by_status(fixture(spark, folder, "outbox_base"))


@query("e3_unresolved_backlog", sql(
    "SELECT 'quarantine' AS backlog, count(*) AS unresolved FROM outbox_base WHERE status = 'quarantined' AND processed_at IS "
    "NULL UNION ALL SELECT 'drift', count(*) FILTER (WHERE p_size > 10) FROM part", "outbox_base"))
def unresolved_backlog(spark, folder):
    held = fixture(spark, folder, "outbox_base").filter("status = 'quarantined'").selectExpr("processed_at AS resolved_at")
    reports = table(spark, folder, "part").selectExpr("CASE WHEN p_size <= 10 THEN p_name END AS resolved_at")
    return metrics.unresolved_backlog(held, reports)


@query("e4_crosswalk_counts", sql(
    "SELECT target_table, count(*) AS crosswalk_count FROM xwalk GROUP BY 1", "xwalk"))
def crosswalk_counts(spark, folder):
    return metrics.crosswalk_counts(crosswalk(spark, folder))


_OUTCOME = "CASE event_id % 5 WHEN 0 THEN 'quarantined' WHEN 1 THEN 'retry' ELSE 'delivered' END AS outcome"


@query("e5_run_summary", sql(
    "SELECT count(*) AS claimed, count(*) FILTER (WHERE outcome = 'delivered') AS delivered, count(*) FILTER (WHERE outcome = "
    "'quarantined') AS quarantined, count(*) FILTER (WHERE outcome = 'retry') AS retried FROM o",
    extra={"o": f"SELECT {_OUTCOME} FROM events"}))
def run_summary(spark, folder):
    return metrics.run_summary(table(spark, folder, "events").selectExpr(_OUTCOME))


@query("e6_count_reconciliation", (
    "SELECT k AS nation, COALESCE(a.n, 0) AS source_rows, COALESCE(b.n, 0) AS target_rows, COALESCE(a.n, 0) - COALESCE(b.n, 0) "
    "AS difference FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1) a FULL OUTER "
    "JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k)"))
def count_reconciliation(spark, folder):
    left = table(spark, folder, "customer").filter("c_nationkey <> 3").selectExpr("c_nationkey AS nation")
    return metrics.reconcile_counts(left, table(spark, folder, "supplier").selectExpr("s_nationkey AS nation"), "nation")


@query("e7_next_version", (
    "SELECT c.c_custkey AS source_entity, COALESCE(max(o_orderkey), 0) + 1 AS next_version FROM customer c LEFT JOIN orders ON "
    "o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1"))
def next_version(spark, folder):
    versions = table(spark, folder, "orders").filter("o_orderstatus = 'F'").selectExpr(
        "o_custkey AS source_entity", "o_orderkey AS version")
    return metrics.next_versions(versions, table(spark, folder, "customer").selectExpr("c_custkey AS source_entity"))


@query("e8_footprint", (
    "SELECT o_custkey AS source_entity, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS target_tables "
    "FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1"))
def footprint(spark, folder):
    mapping = table(spark, folder, "orders").selectExpr(
        "o_custkey AS source_entity", "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS target_table")
    return metrics.footprint(mapping).withColumn("target_tables", F.array_join("target_tables", ","))


_RESULT = (
    "CASE o_orderkey % 4 "
    "WHEN 0 THEN '{\"results\":[{\"entity\":\"e' || CAST(o_custkey AS STRING) || '\",\"status\":\"Failed\",\"error\":\"boom\"},"
    "{\"entity\":\"fine\",\"status\":\"ok\"}]}' "
    "WHEN 1 THEN '{\"redeliver\":{\"results\":[{\"table\":\"t' || CAST(o_custkey AS STRING) || '\",\"status\":\"skipped\"}]}}' "
    "WHEN 2 THEN '{\"entities\":[{\"source_table\":\"s' || CAST(o_custkey AS STRING) || '\",\"error\":\"late\"}]}' "
    "ELSE 'not json' END AS result")


@query("e12_job_failures", (
    "SELECT o_orderkey AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'e' WHEN 1 THEN 't' ELSE 's' END || CAST(o_custkey AS VARCHAR) "
    "AS entity, CASE o_orderkey % 4 WHEN 0 THEN 'Failed' WHEN 1 THEN 'skipped' ELSE 'failed' END AS status, CASE o_orderkey % 4 "
    "WHEN 0 THEN 'boom' WHEN 2 THEN 'late' END AS error FROM orders WHERE o_orderkey % 4 <> 3"))
def job_failures(spark, folder):
    return metrics.job_failures(table(spark, folder, "orders").selectExpr("o_orderkey AS job_id", _RESULT))


@query("b25_error_classes", sql(
    "SELECT error_id, CASE WHEN e IN (0, 1, 2) THEN 'duplicate_key' WHEN e = 3 THEN 'reference_match_missing' WHEN e = 4 THEN "
    "'read_only_reference_missing' WHEN e = 5 THEN 'missing_required_mapping' WHEN e = 6 THEN 'data_quality' ELSE 'unknown' END "
    "AS category, CASE WHEN e IN (0, 2, 5, 6) THEN 'account' WHEN e IN (3, 4) THEN 'nation' END AS target_table, CASE WHEN e IN "
    "(0, 1, 2, 4) THEN 'id' WHEN e = 3 THEN 'n_name' WHEN e = 5 THEN 'name' WHEN e = 6 THEN 'opened' END AS target_column, CASE "
    "WHEN e IN (0, 1, 2, 4) THEN CAST(user_id AS VARCHAR) WHEN e = 3 THEN 'X' || CAST(user_id AS VARCHAR) WHEN e = 6 THEN "
    "CAST(10000 + user_id AS VARCHAR) END AS target_id, CASE WHEN e = 5 THEN 'account.name,account.id' END AS detail, CASE WHEN "
    "e = 7 THEN '0f8fad5b-d9cb-469f-a165-70867728950e' END AS job_id FROM (SELECT event_id AS error_id, event_id % 8 AS e, "
    "user_id FROM events)"))
def error_classes(spark, folder):
    found = diagnose.classify(fixture(spark, folder, "error_log"))
    return found.withColumn("detail", F.array_join("detail", ",")).drop("source_entity", "error")


@query("f1_latest_per_key", (
    "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id "
    "DESC) AS n FROM events) WHERE n = 1"))
def latest_per_key(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type")
    return ordering.latest_per_key(events, ["user_id"], "ts", "event_id")


@query("f2_first_match", (
    "SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS o_orderkey, min(o_orderpriority) AS o_orderpriority "
    "FROM orders GROUP BY 1"))
def first_match(spark, folder):
    return ordering.first_match(table(spark, folder, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("f3_allocate_ids", sql(
    "SELECT c_custkey, 10000000 - 1 + row_number() OVER (ORDER BY external_reference) AS id FROM keyed_customer",
    "keyed_customer"))
def allocate_ids(spark, folder):
    rows = keyed_customer(spark, folder).select("c_custkey", "external_reference")
    return ordering.allocate_ids(rows, "external_reference", "id", 10_000_000).select("c_custkey", "id")


@query("f4_page", (
    "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100"))
def page(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return ordering.page(rows, "c_acctbal", "desc", 3, 50, "c_custkey")


@query("f4_page_info", (
    "SELECT count(*) AS total, 100::BIGINT AS size, greatest(1, CAST(ceil(count(*) / 100.0) AS BIGINT)) AS pages FROM customer"))
def page_info(spark, folder):
    return ordering.page_info(table(spark, folder, "customer"), 500)


@query("f5_top_per_group", (
    "SELECT c_nationkey, c_custkey, c_acctbal, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "
    "c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 5"))
def top_per_group(spark, folder):
    rows = table(spark, folder, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return ordering.top_per_group(rows, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5)


@query("f6_oldest_first", sql(
    "SELECT event_id, created_at FROM outbox_base WHERE status IN ('pending', 'retry') ORDER BY created_at, event_id LIMIT 100",
    "outbox_base"))
def oldest_first(spark, folder):
    waiting = fixture(spark, folder, "outbox_base").filter("status IN ('pending', 'retry')").select("event_id", "created_at")
    return ordering.oldest(waiting, "created_at", "event_id", 100)


@query("f7_newest_nulls_last", sql(
    "SELECT event_id, source_entity, processed_at FROM outbox_base WHERE status = 'dead_letter' ORDER BY processed_at DESC NULLS "
    "LAST, event_id DESC LIMIT 200", "outbox_base"))
def newest_nulls_last(spark, folder):
    dead = fixture(spark, folder, "outbox_base").filter("status = 'dead_letter'").select(
        "event_id", "source_entity", "processed_at")
    return ordering.newest(dead, "processed_at", "event_id", 200)


@query("f8_keep_last_duplicate", (
    "SELECT l_orderkey, l_linenumber, max(l_partkey * 1000 + l_suppkey) AS stamp FROM lineitem GROUP BY 1, 2"))
def keep_last_duplicate(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey * 1000 + l_suppkey AS stamp")
    return ordering.keep_last(rows, ["l_orderkey", "l_linenumber"], "stamp")
