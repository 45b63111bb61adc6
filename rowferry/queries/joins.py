"""Crosswalk, lookup and foreign-key joins, matching by name, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import reference_for, uuid5
from ..functions.text import strip
from ..operators import compare, diagnose, drift, lookups, matching
from ..operators.events import claimable, quarantine_listing
from .fixtures import (
    AS_OF_SQL, SCHEMA, STRIP_SQL, SYSTEM, TARGET, as_of, catalog, control, crosswalk, fixture, footprints,
    keyed_customer, outbox, reference_sql, sql, table, tgt_account, uuid5_sql,
)
from .registry import query


def _account_crosswalk(spark, folder):
    return lookups.entity_crosswalk(crosswalk(spark, folder), "customer", TARGET, "account")


@query("d1_crosswalk_lookup", sql(
    "SELECT c_custkey, x.target_id FROM keyed_customer c LEFT JOIN xwalk x ON c.external_reference = x.external_reference",
    "keyed_customer", "xwalk"))
def crosswalk_lookup(spark, folder):
    rows = keyed_customer(spark, folder).select(
        "c_custkey", "external_reference", F.lit(SYSTEM).alias("source_system"), F.lit("customer").alias("source_entity"),
        F.lit(TARGET).alias("target_system"), F.lit("account").alias("target_table"))
    return lookups.crosswalk_lookup(rows, crosswalk(spark, folder)).select("c_custkey", "target_id")


@query("d2_resolve_by_key", (
    "SELECT c_custkey, CASE WHEN k < 25 THEN k END AS target_id, CASE WHEN k IS NULL THEN 'cannot resolve a row in reference "
    "table nation: no lookup values mapped' WHEN k >= 25 THEN 'nation.n_nationkey=' || CAST(k AS VARCHAR) || ' does not exist; "
    "nation is read-only' END AS lookup_error FROM (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % "
    "5 = 0 THEN c_nationkey + 20 ELSE c_nationkey END AS k FROM customer)"))
def resolve_by_key(spark, folder):
    rows = table(spark, folder, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_nationkey + 20 ELSE c_nationkey "
        "END AS k")
    return lookups.resolve_by_key(rows, "k", table(spark, folder, "nation"), "n_nationkey", "nation").drop("k")


_ASKED = ("CASE WHEN c_custkey % 4 <> 0 THEN 'NATION_' || CAST(c_nationkey AS STRING) END AS n_name",
          "CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 5 AS INT) END AS n_regionkey")


@query("d3_resolve_by_values", sql(
    "SELECT c_custkey, (SELECT min(n.n_nationkey) FROM nation n WHERE (a.n_name IS NULL OR n.n_name = a.n_name) AND "
    "(a.n_regionkey IS NULL OR n.n_regionkey = a.n_regionkey) AND (a.n_name IS NOT NULL OR a.n_regionkey IS NOT NULL)) "
    "AS target_id FROM asked a", extra={"asked": f"SELECT c_custkey, {', '.join(_ASKED)} FROM customer"}))
def resolve_by_values(spark, folder):
    rows = table(spark, folder, "customer").selectExpr("c_custkey", *_ASKED)
    found = lookups.resolve_by_values(rows, ["n_name", "n_regionkey"], table(spark, folder, "nation"), "n_nationkey")
    return found.select("c_custkey", "target_id")


# Rows without a live crosswalk id match target rows on (segment, nation); what is left shares new ids.
_ALLOCATE = {
    "rows_in": "SELECT external_reference, c_custkey, c_mktsegment AS segment, CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE "
               "c_nationkey END AS nation_id FROM keyed_customer",
    "tgt": "SELECT id, segment, nation_id FROM tgt_account WHERE nation_id < 12 AND segment <> 'FURNITURE'",
    "live": "SELECT x.external_reference, CAST(x.target_id AS BIGINT) AS id FROM xwalk x JOIN tgt ON "
            "CAST(tgt.id AS VARCHAR) = x.target_id",
    "step1": "SELECT r.*, l.id AS live_id, (SELECT min(t.id) FROM tgt t WHERE t.segment = r.segment AND (r.nation_id IS NULL "
             "OR t.nation_id = r.nation_id)) AS match_id FROM rows_in r LEFT JOIN live l USING (external_reference)",
    "groups": "SELECT segment, nation_id, min(external_reference) AS ref FROM step1 WHERE live_id IS NULL AND match_id IS NULL "
              "GROUP BY 1, 2",
    "numbered": "SELECT *, greatest(10000000, (SELECT max(id) + 1 FROM tgt)) - 1 + row_number() OVER (ORDER BY ref) AS id "
                "FROM groups",
}


@query("d4_match_or_allocate", sql(
    "SELECT c_custkey, COALESCE(live_id, match_id, n.id) AS target_id, CASE WHEN live_id IS NOT NULL THEN 'update' WHEN match_id "
    "IS NOT NULL THEN 'match' WHEN n.ref = s.external_reference THEN 'insert' ELSE 'match' END AS action FROM step1 s "
    "LEFT JOIN numbered n ON live_id IS NULL AND match_id IS NULL AND n.segment = s.segment AND n.nation_id IS NOT DISTINCT "
    "FROM s.nation_id", "keyed_customer", "xwalk", "tgt_account", extra=_ALLOCATE))
def match_or_allocate(spark, folder):
    rows = keyed_customer(spark, folder).selectExpr(
        "external_reference", "c_custkey", "c_mktsegment AS segment",
        "CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE c_nationkey END AS nation_id")
    target = tgt_account(spark, folder).filter("nation_id < 12 AND segment <> 'FURNITURE'")
    found = lookups.match_or_allocate(rows, _account_crosswalk(spark, folder), target, "id", 10_000_000,
                                      ["segment", "nation_id"])
    return found.select("c_custkey", "target_id", "action")


@query("d5_carried_ids", sql(
    "SELECT c_custkey, COALESCE(x.target_id, 'C' || CAST(c_custkey AS VARCHAR)) AS target_id, CASE WHEN x.target_id IS NULL "
    "THEN 'insert' ELSE 'update' END AS action FROM keyed_customer c LEFT JOIN xwalk x ON c.external_reference = "
    "x.external_reference", "keyed_customer", "xwalk"))
def carried_ids(spark, folder):
    rows = keyed_customer(spark, folder).select(
        "c_custkey", "external_reference", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"))
    return lookups.carried_ids(rows, _account_crosswalk(spark, folder), "id").select("c_custkey", "target_id", "action")


@query("d6_stale_crosswalk", sql(
    "SELECT external_reference, target_id FROM xwalk WHERE target_id NOT IN (SELECT CAST(id AS VARCHAR) FROM tgt_account)",
    "xwalk", "tgt_account"))
def stale_crosswalk(spark, folder):
    return lookups.stale_crosswalk(crosswalk(spark, folder), tgt_account(spark, folder), "id").select(
        "external_reference", "target_id")


@query("d7_propagate_parent", sql(
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'kept' ELSE x.target_id END AS account_id FROM keyed_customer c "
    "LEFT JOIN xwalk x ON c.external_reference = x.external_reference", "keyed_customer", "xwalk"))
def propagate_parent(spark, folder):
    child = keyed_customer(spark, folder).select(
        "c_custkey", "external_reference", F.when(F.col("c_custkey") % 2 == 0, "kept").alias("account_id"))
    filled = lookups.propagate_parent(child, "account_id", _account_crosswalk(spark, folder))
    return filled.select("c_custkey", "account_id")


_RESOLVED = {
    "live": "SELECT x.external_reference, x.target_id FROM xwalk x JOIN tgt_account t ON CAST(t.id AS VARCHAR) = x.target_id "
            "UNION ALL SELECT " + reference_sql("buyer", "c_custkey") + ", CAST(1000 + c_custkey AS VARCHAR) FROM customer "
            "WHERE c_custkey % 15 = 6",
    "values_in": "SELECT DISTINCT o_custkey FROM orders",
    "hits": f"SELECT o_custkey, 1 AS pos, target_id FROM values_in JOIN live ON external_reference = "
            f"{reference_sql('buyer', 'o_custkey')} UNION ALL SELECT o_custkey, 2, target_id FROM values_in JOIN live ON "
            f"external_reference = {reference_sql('customer', 'o_custkey')}",
    "best": "SELECT o_custkey, CAST(arg_min(target_id, pos) AS BIGINT) AS account_id FROM hits GROUP BY o_custkey",
}


def _resolved(spark, folder):
    buyers = table(spark, folder, "customer").filter("c_custkey % 15 = 6")
    more = buyers.select(
        F.lit(SYSTEM).alias("source_system"), F.lit("buyer").alias("source_entity"),
        reference_for(buyers, SYSTEM, SCHEMA, "buyer", ["c_custkey"]).alias("external_reference"),
        F.lit(TARGET).alias("target_system"), F.lit("account").alias("target_table"),
        (F.col("c_custkey") + 1000).cast("string").alias("target_id"))
    links = crosswalk(spark, folder).unionByName(more)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return lookups.resolve_references(orders, "o_custkey", "account_id", links, tgt_account(spark, folder), "id",
                                      ["customer", "buyer"], SYSTEM, SCHEMA, ["o_orderkey"])


@query("d8_resolve_references", sql(
    "SELECT o_orderkey, o.o_custkey, account_id FROM orders o LEFT JOIN best b ON o.o_custkey = b.o_custkey", "xwalk",
    "tgt_account", extra=_RESOLVED))
def resolve_references(spark, folder):
    return _resolved(spark, folder)


@query("d8_unresolved_report", sql(
    "SELECT 'order_head' AS target_table, 'account_id' AS target_column, 'o_custkey' AS source_column, "
    "CAST(o.o_custkey AS VARCHAR) AS source_value FROM orders o LEFT JOIN best b ON o.o_custkey = b.o_custkey WHERE "
    "account_id IS NULL", "xwalk", "tgt_account", extra=_RESOLVED))
def unresolved_report(spark, folder):
    return lookups.unresolved(_resolved(spark, folder), "o_custkey", "account_id", "order_head", "account_id")


_NAMED = ("CASE c_custkey % 4 WHEN 0 THEN '  nation_' || CAST(c_nationkey AS STRING) || ' ' WHEN 1 THEN 'Nation_' || "
          "CAST(c_nationkey AS STRING) WHEN 2 THEN 'n' || CAST(c_nationkey AS STRING) ELSE 'atlantis' END AS place")


@query("d9_reconcile", sql(
    "SELECT c_custkey, COALESCE(a.n_nationkey, b.n_nationkey) AS target_id, CASE WHEN a.n_nationkey IS NOT NULL THEN 'n_name' "
    "WHEN b.n_nationkey IS NOT NULL THEN 'short' END AS matched_on FROM s LEFT JOIN nation a ON lower(a.n_name) = "
    "lower(trim(place)) LEFT JOIN nation b ON 'n' || CAST(b.n_nationkey AS VARCHAR) = lower(trim(place))",
    extra={"s": f"SELECT c_custkey, {_NAMED} FROM customer"}))
def reconcile(spark, folder):
    places = table(spark, folder, "customer").selectExpr("c_custkey", _NAMED)
    nations = table(spark, folder, "nation").selectExpr("n_nationkey", "n_name", "'N' || CAST(n_nationkey AS STRING) AS short")
    return lookups.reconcile(places, "c_custkey", "place", nations, "n_nationkey", ["n_name", "short"]).select(
        "c_custkey", "target_id", "matched_on")


@query("d9_unmatched", sql(
    "SELECT c_custkey, place FROM s WHERE place = 'atlantis'", extra={"s": f"SELECT c_custkey, {_NAMED} FROM customer"}))
def unmatched(spark, folder):
    places = table(spark, folder, "customer").selectExpr("c_custkey", _NAMED)
    nations = table(spark, folder, "nation").selectExpr("n_nationkey", "n_name", "'N' || CAST(n_nationkey AS STRING) AS short")
    found = lookups.reconcile(places, "c_custkey", "place", nations, "n_nationkey", ["n_name", "short"])
    return found.filter("target_id IS NULL").select("c_custkey", "place")


@query("d10_flatten", (
    "SELECT o_orderkey, c_name, c_nationkey, n_name, n_regionkey, r_name, r_regionkey, c.c_name AS customer_c_name FROM orders "
    "LEFT JOIN customer c ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON "
    "r_regionkey = n_regionkey"))
def flatten(spark, folder):
    frames = {n: table(spark, folder, n) for n in ("orders", "customer", "nation", "region")}
    edges = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
             ("nation", "n_regionkey", "region", "r_regionkey")]
    columns = [("orders", "o_orderkey"), ("customer", "c_name"), ("customer", "c_nationkey"), ("nation", "n_name"),
               ("nation", "n_regionkey"), ("region", "r_name"), ("region", "r_regionkey"), ("customer", "c_name")]
    return compare.flatten(frames, "orders", edges, columns)


@query("d11_claimable", sql(
    "SELECT event_id, source_entity FROM outbox JOIN control USING (source_entity, target_system) WHERE enabled AND status IN "
    f"('pending', 'retry') AND available_at <= {AS_OF_SQL}", "outbox", "control"))
def claimable_events(spark, folder):
    return claimable(outbox(spark, folder), control(spark, folder), as_of()).select("event_id", "source_entity")


def _quarantine(spark, folder):
    return outbox(spark, folder).filter("status = 'quarantined'").select(
        "event_id", "created_at", F.when(F.col("event_id") % 10 == 4, as_of()).alias("resolved_at"))


@query("d12_quarantine_listing", sql(
    "SELECT event_id, created_at, source_entity, status AS outbox_status, attempts, operation, external_reference FROM outbox "
    "WHERE status = 'quarantined' AND event_id % 10 <> 4 ORDER BY created_at DESC, event_id DESC LIMIT 200", "outbox"))
def quarantine_list(spark, folder):
    return quarantine_listing(_quarantine(spark, folder), outbox(spark, folder), 200).drop("resolved_at")


_COMPARED = {
    "src": f"SELECT external_reference, substr({STRIP_SQL}, 1, 12) AS name, c_mktsegment AS segment, c_acctbal AS balance "
           "FROM keyed_customer WHERE c_custkey % 21 <> 0",
    "sides": "SELECT COALESCE(s.external_reference, x.external_reference) AS external_reference, x.target_id, "
             "s.external_reference IS NULL AS missing_in_source, s.external_reference IS NOT NULL AND x.target_id IS NULL "
             "AS missing_in_target, t.id IS NOT NULL AS compared, s.name AS s1, t.name AS t1, s.segment AS s2, t.segment AS t2, "
             "CAST(s.balance AS VARCHAR) AS s3, CAST(t.balance AS VARCHAR) AS t3 FROM src s FULL OUTER JOIN xwalk x ON "
             "s.external_reference = x.external_reference LEFT JOIN tgt_account t ON CAST(t.id AS VARCHAR) = x.target_id",
    "fields": " UNION ALL ".join(
        f"SELECT external_reference, target_id, missing_in_source, missing_in_target, compared, '{n}' AS field, s{i} AS source, "
        f"t{i} AS target, compared AND s{i} IS NOT DISTINCT FROM t{i} AS matches FROM sides"
        for i, n in ((1, "name"), (2, "segment"), (3, "balance"))),
}


def _compared(spark, folder):
    rows = keyed_customer(spark, folder).filter("c_custkey % 21 <> 0").select(
        "external_reference", F.substring(strip(F.col("c_name")), 1, 12).alias("name"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return compare.compare_fields(rows, crosswalk(spark, folder), tgt_account(spark, folder), "id",
                                  ["name", "segment", "balance"])


@query("d15_field_comparison", sql("SELECT * FROM fields", "keyed_customer", "xwalk", "tgt_account", extra=_COMPARED))
def field_comparison(spark, folder):
    return _compared(spark, folder)


@query("d15_mismatch_counts", sql(
    "SELECT field, count(*) AS rows, count(*) FILTER (WHERE matches) AS matching, count(*) FILTER (WHERE compared AND NOT "
    "matches) AS differing, count(*) FILTER (WHERE missing_in_target) AS missing_in_target, count(*) FILTER (WHERE "
    "missing_in_source) AS missing_in_source FROM fields GROUP BY field", "keyed_customer", "xwalk", "tgt_account",
    extra=_COMPARED))
def mismatch_counts(spark, folder):
    return compare.mismatch_counts(_compared(spark, folder))


_CLAIMS = ("SELECT 'CRM' AS target_system, 'account' AS target_table, CAST(o_custkey AS VARCHAR) AS target_id, "
           "o_orderpriority AS source_entity, CAST(o_orderkey - o_orderkey % 2 AS VARCHAR) AS external_reference FROM orders")


@query("d16_ownership_conflicts", sql(
    "SELECT target_system, target_table, target_id, count(*) AS owners FROM (SELECT DISTINCT * FROM claims) GROUP BY ALL "
    "HAVING count(*) > 1", extra={"claims": _CLAIMS}))
def ownership_conflicts(spark, folder):
    claims = table(spark, folder, "orders").selectExpr(
        "'CRM' AS target_system", "'account' AS target_table", "CAST(o_custkey AS STRING) AS target_id",
        "o_orderpriority AS source_entity", "CAST(o_orderkey - o_orderkey % 2 AS STRING) AS external_reference")
    return diagnose.ownership_conflicts(claims)


_ENTITY = ("'ent_' || CAST(s_suppkey AS STRING) AS source_entity", "'account' AS target_table",
           "'SRC' AS source_system", "'erp' AS source_schema", "s_suppkey % 5 = 0 AS composite",
           "CASE WHEN s_suppkey % 7 = 3 THEN 'other' ELSE 'id' END AS mapped_column")
_OWNED = ("'ent_' || CAST(c_custkey % 60 AS STRING) AS source_entity", "'ref' || CAST(c_custkey AS STRING) AS external_reference",
          "'account' AS target_table", "CAST(c_custkey AS STRING) AS target_id")
_DUPES = ("event_id AS error_id", "'ent_' || CAST(user_id % 50 AS STRING) AS source_entity", "'account' AS target_table",
          "CAST(user_id AS STRING) AS target_id")
_REPAIR = {
    "errs": f"SELECT {', '.join(_DUPES)} FROM events WHERE event_type = 'error'",
    "ents": f"SELECT {', '.join(_ENTITY)} FROM supplier",
    "owned": f"SELECT {', '.join(_OWNED)} FROM customer WHERE c_custkey % 4 = 0",
    "planned": "SELECT error_id, e.source_entity, e.target_table, e.target_id, CASE WHEN NOT composite AND mapped_column = 'id' "
               "THEN (SELECT 1) END AS from_key, composite, mapped_column, EXISTS (SELECT 1 FROM tgt_account t WHERE "
               "CAST(t.id - 1000 AS VARCHAR) = e.target_id) AS there FROM errs e LEFT JOIN ents n ON n.source_entity = "
               "e.source_entity",
    "judged": "SELECT p.*, EXISTS (SELECT 1 FROM owned o WHERE o.target_id = p.target_id AND NOT (o.source_entity = "
              "p.source_entity AND p.from_key IS NULL)) AS conflict FROM planned p",
    "texts": "SELECT *, concat_ws('; ', CASE WHEN COALESCE(composite, true) THEN 'no_single_key' "
             "END, CASE WHEN NOT composite AND mapped_column <> 'id' THEN 'not_mapped_from_key:' || mapped_column END, CASE WHEN "
             "NOT there THEN 'target_row_gone' END, CASE WHEN conflict THEN 'id_of_another_row' END) AS reasons FROM judged",
}


@query("d17_repair_plan", sql(
    "SELECT error_id, source_entity, target_id, reasons = '' AS safe_to_repair, reasons, CASE WHEN from_key IS NOT NULL THEN "
    + uuid5_sql("'SRC|erp|' || source_entity || '|' || target_id") + " END AS external_reference FROM texts", "tgt_account", extra=_REPAIR))
def repair_plan(spark, folder):
    errors = table(spark, folder, "events").filter("event_type = 'error'").selectExpr(*_DUPES)
    entities = table(spark, folder, "supplier").selectExpr(*_ENTITY).withColumn(
        "primary_key", F.when(F.col("composite"), F.array(F.lit("id"), F.lit("part"))).otherwise(F.array(F.lit("id")))
    ).drop("composite")
    owned = table(spark, folder, "customer").filter("c_custkey % 4 = 0").selectExpr(*_OWNED)
    targets = tgt_account(spark, folder).selectExpr("'account' AS target_table", "CAST(id - 1000 AS STRING) AS target_id")
    plan = diagnose.repair_plan(errors, entities, targets, owned)
    return plan.select("error_id", "source_entity", "target_id", "safe_to_repair",
                       F.array_join("reasons", "; ").alias("reasons"), "external_reference")


# The same ids are claimed for a second entity, and some crosswalk rows are there without an id.
_CONTESTED = ("event_id + 10000000000 AS error_id", "'ent_' || CAST((user_id + 1) % 50 AS STRING) AS source_entity",
              "'account' AS target_table", "CAST(user_id AS STRING) AS target_id")
_REPAIRED = _REPAIR | {
    "errs": f"SELECT {', '.join(_DUPES)} FROM events WHERE event_type = 'error' UNION ALL SELECT {', '.join(_CONTESTED)} "
            "FROM events WHERE event_type = 'error' AND event_id % 3 = 0",
    "safe": "SELECT error_id, source_entity, target_id, " + uuid5_sql("'SRC|erp|' || source_entity || '|' || target_id")
            + " AS external_reference FROM texts WHERE reasons = ''",
    "repairs": "SELECT * FROM safe QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY error_id) = 1",
    "before": "SELECT source_entity, external_reference, target_id, 'earlier' AS updated_at FROM owned UNION ALL SELECT "
              "'ent_' || CAST(c_custkey % 50 AS VARCHAR), " + uuid5_sql("'SRC|erp|ent_' || CAST(c_custkey % 50 AS VARCHAR) || '|' || "
              "CAST(c_custkey AS VARCHAR)") + ", NULL, 'earlier' FROM customer WHERE c_custkey % 4 = 1",
}


def _repairs(spark, folder):
    events = table(spark, folder, "events").filter("event_type = 'error'")
    errors = events.selectExpr(*_DUPES).unionByName(events.filter("event_id % 3 = 0").selectExpr(*_CONTESTED))
    entities = table(spark, folder, "supplier").selectExpr(*_ENTITY).withColumn(
        "primary_key", F.when(F.col("composite"), F.array(F.lit("id"), F.lit("part"))).otherwise(F.array(F.lit("id")))
    ).drop("composite")
    customers = table(spark, folder, "customer")
    waiting = customers.filter("c_custkey % 4 = 1").selectExpr(
        "'ent_' || CAST(c_custkey % 50 AS STRING) AS source_entity", "'account' AS target_table", "CAST(c_custkey AS STRING) AS _id")
    waiting = waiting.select("source_entity", uuid5(F.concat_ws("|", F.lit("SRC"), F.lit("erp"), "source_entity", "_id")).alias(
        "external_reference"), "target_table", F.lit(None).cast("string").alias("target_id"))
    owned = customers.filter("c_custkey % 4 = 0").selectExpr(*_OWNED).unionByName(waiting).select(
        F.lit("SRC").alias("source_system"), "*", F.lit("DST").alias("target_system"), F.lit("earlier").alias("updated_at"))
    targets = tgt_account(spark, folder).selectExpr("'account' AS target_table", "CAST(id - 1000 AS STRING) AS target_id")
    plan = diagnose.repair_plan(errors, entities, targets, owned)
    return diagnose.apply_repairs(plan, owned, "DST", "operator", F.lit("now"))


@query("d17_repaired_crosswalk", sql(
    "SELECT COALESCE(b.source_entity, r.source_entity) AS source_entity, COALESCE(b.external_reference, r.external_reference) AS "
    "external_reference, COALESCE(r.target_id, b.target_id) AS target_id, CASE WHEN r.target_id IS NULL THEN b.updated_at ELSE 'now' "
    "END AS updated_at FROM before b FULL JOIN repairs r ON b.source_entity = r.source_entity AND b.external_reference = "
    "r.external_reference", "tgt_account", extra=_REPAIRED))
def repaired_crosswalk(spark, folder):
    return _repairs(spark, folder)[0].select("source_entity", "external_reference", "target_id", "updated_at")


@query("d17_repair_audit", sql(
    "SELECT source_entity, 'crosswalk_repaired' AS action, '{\"external_reference\":\"' || external_reference || '\",\"target_id\":\"' || "
    "target_id || '\",\"target_table\":\"account\"}' AS details, 'operator' AS performed_by FROM repairs", "tgt_account", extra=_REPAIRED))
def repair_audit(spark, folder):
    return _repairs(spark, folder)[1].drop("performed_at")


@query("d17_repair_outcomes", sql(
    "SELECT t.error_id, t.source_entity, t.target_id, r.target_id IS NOT NULL AS applied, CASE WHEN reasons = '' AND r.target_id IS NULL "
    "THEN 'id_of_another_row' ELSE reasons END AS reasons FROM texts t LEFT JOIN repairs r ON t.reasons = '' AND r.target_id = "
    "t.target_id AND r.source_entity = t.source_entity", "tgt_account", extra=_REPAIRED))
def repair_outcomes(spark, folder):
    return _repairs(spark, folder)[2].select(
        "error_id", "source_entity", "target_id", "applied", F.array_join("reasons", "; ").alias("reasons"))


@query("d18_affected_entities", sql(
    "SELECT source_entity, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS affected_tables FROM footprints WHERE "
    "table_name IN (SELECT DISTINCT table_name FROM catalog_v1 WHERE position = 3 AND nullable) GROUP BY source_entity",
    "footprints", "catalog_v1"))
def affected(spark, folder):
    changed = catalog(spark, folder, 1).filter("position = 3 AND nullable")
    found = drift.affected_entities(footprints(spark, folder), changed)
    return found.withColumn("affected_tables", F.array_join("affected_tables", ","))


# Names of source columns come from parts, names of target columns from customers' segments and suppliers.
_SOURCE_NAMES = ("'t' || CAST(p_partkey AS STRING) AS source_table",
                 "CASE p_partkey % 6 WHEN 0 THEN 'Small_Ring' WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN p_name "
                 "WHEN 3 THEN 'the ' || p_name || ' no' WHEN 4 THEN 'supp' || CAST(p_partkey % 40 AS STRING) ELSE 'zzz' END "
                 "AS source_column")
_TARGET_NAMES = ("s_suppkey AS position", "'t' || CAST(s_suppkey AS STRING) AS target_table",
                 "CASE s_suppkey % 4 WHEN 0 THEN 'supp' || CAST(s_suppkey % 30 AS STRING) WHEN 1 THEN 'SmallRing' WHEN 2 THEN "
                 "'old_plate' || CAST(s_suppkey AS STRING) ELSE 'gear' END AS target_column")
_MATCH = {
    "srcs": f"SELECT {', '.join(_SOURCE_NAMES)} FROM part",
    "tgts": f"SELECT {', '.join(_TARGET_NAMES)} FROM supplier",
    "n1": "SELECT DISTINCT lower(replace(replace(source_column, '_', ''), ' ', '')) AS n FROM srcs",
    "n2": "SELECT *, lower(replace(replace(target_column, '_', ''), ' ', '')) AS t FROM tgts",
    "pairs": "SELECT n, position, target_table, target_column, CASE WHEN n = t THEN 0 ELSE 1 END AS kind FROM n1 JOIN n2 ON "
             "contains(t, n) OR contains(n, t)",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY kind, position) AS r FROM pairs) WHERE r = 1",
}


@query("d19_match_columns", sql(
    "SELECT source_table, source_column, target_table, target_column, CASE kind WHEN 0 THEN 0.6 WHEN 1 THEN 0.5 ELSE 0.0 "
    "END::DOUBLE AS confidence FROM srcs LEFT JOIN best ON n = lower(replace(replace(source_column, '_', ''), ' ', ''))",
    extra=_MATCH))
def match_columns(spark, folder):
    source = table(spark, folder, "part").selectExpr(*_SOURCE_NAMES)
    return matching.match_columns(source, table(spark, folder, "supplier").selectExpr(*_TARGET_NAMES))


_RANK_SOURCE = ("CASE c_custkey % 5 WHEN 0 THEN 'stock_' || CAST(c_custkey % 90 AS STRING) WHEN 1 THEN 'Ring_data' WHEN 2 THEN "
                "'x_' || CAST(c_custkey AS STRING) || '_' WHEN 3 THEN 'gear' ELSE 'qq' || CAST(c_custkey AS STRING) END "
                "AS source_table")
_RANK_TARGET = ("s_suppkey AS position", "CASE s_suppkey % 5 WHEN 0 THEN 'stock_' || CAST(s_suppkey AS STRING) WHEN 1 THEN "
                "'my_ring_' || CAST(s_suppkey AS STRING) WHEN 2 THEN 'GEAR' WHEN 3 THEN 'ea' ELSE 'stock' || CAST(s_suppkey AS "
                "STRING) END AS target_table")
_RANK = {
    "s": f"SELECT DISTINCT {_RANK_SOURCE} FROM customer", "t": f"SELECT {', '.join(_RANK_TARGET)} FROM supplier",
    "pairs": "SELECT source_table, target_table, position, CASE WHEN lower(source_table) = lower(target_table) THEN 1.0 WHEN "
             "contains(lower(target_table), lower(source_table)) OR contains(lower(source_table), lower(target_table)) THEN 0.7 "
             "WHEN len(list_filter(string_split(lower(source_table), '_'), lambda p: contains(lower(target_table), p))) > 0 "
             "THEN 0.4 ELSE 0.0 END AS score FROM s CROSS JOIN t",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY source_table ORDER BY score DESC, position) AS rank FROM pairs",
}


@query("d20_rank_tables", sql(
    "SELECT source_table, CAST(rank AS INTEGER) AS rank, target_table, score::DOUBLE AS score FROM ranked WHERE rank <= 5",
    extra=_RANK))
def rank_tables(spark, folder):
    source = table(spark, folder, "customer").selectExpr(_RANK_SOURCE).distinct()
    return matching.rank_tables(source, table(spark, folder, "supplier").selectExpr(*_RANK_TARGET))


_JOBS = ("o_orderkey AS job_id", "o_orderdate AS created_at",
         "CASE o_orderkey % 3 WHEN 0 THEN 'refresh of ENT_' || CAST(o_custkey AS STRING) || ' failed' WHEN 1 THEN "
         "'{\"entity\": \"ent_' || CAST(o_custkey % 30 AS STRING) || '\"}' ELSE 'all fine' END AS text")
_DIAGNOSE = {
    "jobs": f"SELECT {', '.join(_JOBS)} FROM orders",
    "foot": "SELECT DISTINCT source_entity, table_name FROM footprints WHERE source_entity NOT LIKE '%4'",
    "props": "SELECT 'ent_' || CAST(p_partkey % 97 AS VARCHAR) AS source_entity, p_partkey AS proposal_id, CASE WHEN p_size > 25 "
             "THEN 'approved' ELSE 'draft' END AS status FROM part",
    "latest": "SELECT source_entity, max(proposal_id) AS proposal_id, arg_max(status, proposal_id) AS pstatus FROM props "
              "GROUP BY 1",
    "links": "SELECT 'ent_' || CAST(c_custkey % 71 AS VARCHAR) AS source_entity, count(*) AS n FROM customer GROUP BY 1",
    "tcounts": "SELECT table_name, count(*) AS n FROM catalog_v2_kept WHERE nullable GROUP BY 1",
    "totals": "SELECT source_entity, CAST(sum(COALESCE(n, 0)) AS BIGINT) AS n FROM foot LEFT JOIN tcounts USING (table_name) "
              "GROUP BY 1",
    "named": "SELECT source_entity, arg_max(job_id, (created_at, job_id)) AS job_id FROM entities JOIN jobs ON "
             "contains(lower(text), source_entity) GROUP BY 1",
    "fails": "SELECT o_orderkey AS job_id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "wide": "SELECT e.source_entity, e.status, s_suppkey % 11 <> 0 AS control_enabled, l.proposal_id AS latest_proposal_id, "
            "l.pstatus AS latest_proposal_status, COALESCE(k.n, 0) AS crosswalk_rows, COALESCE(t.n, 0) AS target_rows, "
            "j.job_id AS latest_job, t.source_entity IS NULL AS bare, COALESCE(f.n, 0) AS fails FROM entities e LEFT JOIN latest "
            "l USING (source_entity) LEFT JOIN links k USING (source_entity) LEFT JOIN totals t USING (source_entity) LEFT JOIN "
            "named j USING (source_entity) LEFT JOIN fails f ON f.job_id = j.job_id",
    "advised": "SELECT *, concat_ws('; ', CASE WHEN status = 'paused' THEN 'entity_paused' "
               "END, CASE WHEN bare THEN 'no_target_tables' END, CASE WHEN "
               "NOT bare AND target_rows = 0 THEN 'targets_empty' "
               "END, CASE WHEN fails > 0 THEN 'last_job_failed' "
               "END) AS a FROM wide",
}


@query("d22_delivery_diagnosis", sql(
    "SELECT source_entity, status, control_enabled, latest_proposal_id, latest_proposal_status, crosswalk_rows, target_rows, "
    "latest_job, CASE WHEN a = '' THEN 'nothing_in_the_way' ELSE a END AS recommendations "
    "FROM advised", "entities", "footprints", "catalog_v2_kept", extra=_DIAGNOSE))
def delivery_diagnosis(spark, folder):
    base = fixture(spark, folder, "entities")
    foot = footprints(spark, folder).filter("source_entity NOT LIKE '%4'").groupBy("source_entity").agg(
        F.collect_set("table_name").alias("target_tables"))
    entities = base.join(foot, "source_entity", "left").withColumn(
        "target_tables", F.coalesce("target_tables", F.array().cast("array<string>")))
    switches = base.selectExpr("source_entity", "s_suppkey % 11 <> 0 AS enabled")
    proposals = table(spark, folder, "part").selectExpr(
        "'ent_' || CAST(p_partkey % 97 AS STRING) AS source_entity", "p_partkey AS proposal_id", "p_partkey AS created_at",
        "CASE WHEN p_size > 25 THEN 'approved' ELSE 'draft' END AS status")
    links = table(spark, folder, "customer").selectExpr("'ent_' || CAST(c_custkey % 71 AS STRING) AS source_entity")
    counts = fixture(spark, folder, "catalog_v2_kept").filter("nullable").groupBy(
        F.col("table_name").alias("target_table")).agg(F.count("*").alias("rows"))
    jobs = table(spark, folder, "orders").selectExpr(*_JOBS)
    failures = table(spark, folder, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS job_id")
    found = diagnose.delivery_diagnosis(entities.drop("s_suppkey"), switches, proposals, links, counts, jobs, failures)
    return found.withColumn("recommendations", F.array_join("recommendations", "; "))


@query("d23_referential_subset", (
    "SELECT 'nation' AS table_name, n_nationkey AS id FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE "
    "c_acctbal > 9000) UNION ALL SELECT 'region', r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation "
    "WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000))"))
def referential_subset(spark, folder):
    written = {"customer": table(spark, folder, "customer").filter("c_acctbal > 9000")}
    links = [("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
    needed = lookups.referenced_rows(written, links, {n: table(spark, folder, n) for n in ("nation", "region")})
    return needed["nation"].selectExpr("'nation' AS table_name", "n_nationkey AS id").unionByName(
        needed["region"].selectExpr("'region' AS table_name", "r_regionkey AS id"))


_TREE = ("WITH RECURSIVE used(id) AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_partkey % 4 = 1 UNION SELECT p_partkey // 5 "
         "FROM part JOIN used ON p_partkey = id WHERE p_partkey >= 5), found AS (SELECT DISTINCT id FROM used JOIN part ON p_partkey = id) ")


@query("d23_own_parents", (
    _TREE + "SELECT 'category' AS table_name, id::BIGINT AS id FROM found UNION ALL SELECT 'region', r_regionkey FROM region WHERE r_regionkey IN "
    "(SELECT id % 7 FROM found)"))
def own_parents(spark, folder):
    """Lookup rows with parents in their own table, several levels up, and a second lookup table behind them."""
    categories = table(spark, folder, "part").selectExpr(
        "p_partkey AS id", "CASE WHEN p_partkey >= 5 THEN p_partkey DIV 5 END AS parent_id", "p_partkey % 7 AS region_id")
    regions = table(spark, folder, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS id")
    written = {"lineitem": table(spark, folder, "lineitem").filter("l_quantity > 45 AND l_partkey % 4 = 1")}
    links = [("category", "region_id", "region", "id"), ("lineitem", "l_partkey", "category", "id"), ("category", "parent_id", "category", "id")]
    needed = lookups.referenced_rows(written, links, {"category": categories, "region": regions})
    return needed["category"].selectExpr("'category' AS table_name", "id").unionByName(needed["region"].selectExpr("'region' AS table_name", "id"))
