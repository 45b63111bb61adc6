"""Composed jobs: event delivery, entity refresh, full rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import ColumnContract, FieldMapping, ForeignKey, TableContract, TargetContract, TargetProfile
from ..functions.keys import checksum, reference_for, row_json
from ..operators import lookups, ordering, validation
from ..operators.union import union_all
from ..plans import delivery
from ..sources.workspace import materialise
from .fixtures import (
    AS_OF_SQL, MODEL, REMAP, REMAP_SQL, SCHEMA, STRIP_SQL, SYSTEM, TARGET, as_of, crosswalk, fixture,
    keyed_customer, reference_sql, sql, table, tgt_account,
)
from .registry import query

ROW = T.StructType([
    T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_custkey", T.LongType()),
    T.StructField("c_mktsegment", T.StringType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("opened_on", T.DateType()),
])
CUSTOMER = delivery.Entity(
    "customer", SCHEMA, ("c_custkey",), (
        FieldMapping("c_name", "account", "name", "trim"), FieldMapping("c_mktsegment", "account", "segment", REMAP),
        FieldMapping("c_nationkey", "account", "nation_id"), FieldMapping("c_acctbal", "account", "balance"),
        FieldMapping("c_acctbal", "account_detail", "balance"),
        FieldMapping("opened_on", "account_detail", "opened", "cast:date->datetime"),
    ), ROW, {"nation": ("nation",)})
PROFILE = TargetProfile(TARGET, frozenset({"account"}), 10_000_000, frozenset({"nation"}))

_DETAIL = "id bigint, account_id bigint, balance double, opened timestamp_ntz"


def _nation_links(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").filter("n_nationkey <> 7")
    return nations.select(
        F.lit(SYSTEM).alias("source_system"), F.lit("nation").alias("source_entity"),
        reference_for(nations, SYSTEM, SCHEMA, "nation", ["n_nationkey"]).alias("external_reference"),
        F.lit(TARGET).alias("target_system"), F.lit("nation").alias("target_table"),
        F.col("n_nationkey").cast("string").alias("target_id"))


def _state(spark: SparkSession, folder: str, details: DataFrame | None = None) -> delivery.TargetState:
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    links = crosswalk(spark, folder).unionByName(_nation_links(spark, folder))
    empty = spark.createDataFrame([], _DETAIL)
    return delivery.TargetState(
        {"account": tgt_account(spark, folder), "account_detail": empty if details is None else details,
         "nation": nations}, links)


_EVENTS = {
    "insert": (0, "true", "c_acctbal", "0"),
    "update": (1, "c_custkey % 4 = 0", "c_acctbal + 5", "1"),
    "deactivate": (2, "c_custkey % 9 = 0", "c_acctbal + 7", "2"),
}


def _outbox(spark: SparkSession, folder: str) -> DataFrame:
    rows = None
    source = keyed_customer(spark, folder)
    for operation, (number, condition, balance, days) in _EVENTS.items():
        some = source.filter(condition).withColumn("c_acctbal", F.expr(balance))
        payload = row_json(some, ROW.fieldNames())
        some = some.select(
            (F.col("c_custkey") * 10 + number).alias("event_id"), "external_reference",
            F.lit("customer").alias("source_entity"), F.lit(TARGET).alias("target_system"),
            F.lit(operation).alias("operation"), payload.alias("payload"), checksum(payload).alias("payload_checksum"),
            F.expr("CASE WHEN c_custkey % 6 = 5 THEN 'processing' ELSE 'pending' END").alias("status"),
            F.lit(0).alias("attempts"), F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '{days}' DAY").alias("created_at"))
        rows = some if rows is None else rows.unionByName(some)
    return rows.withColumns({
        "available_at": F.col("created_at"), "source_updated_at": F.col("created_at"),
        "processed_at": F.lit(None).cast("timestamp_ntz"), "last_error_code": F.lit(None).cast("string"),
        "last_error_message": F.lit(None).cast("string")})


def _delivered(spark: SparkSession, folder: str) -> delivery.Delivery:
    switch = spark.createDataFrame([("customer", TARGET, True)], "source_entity string, target_system string, enabled boolean")
    held = spark.createDataFrame([], "event_id bigint, errors array<string>, payload_snapshot string")
    letters = spark.createDataFrame([], (
        "event_id string, external_reference string, source_entity string, operation string, source_updated_at timestamp_ntz, "
        "payload_checksum string, active boolean, accepted_at timestamp_ntz"))
    return delivery.deliver_events(_outbox(spark, folder), switch, _state(spark, folder), held, letters, CUSTOMER, MODEL,
                                   PROFILE, SYSTEM, as_of())


_VALID = (f"COALESCE({STRIP_SQL}, '') <> '' AND {REMAP_SQL} <> 'FURNITURE'")


def _job_sql(good: str) -> dict[str, str]:
    """Accounts and details after delivery of `good`: one row per reference with its values."""
    return {
        "good": good,
        "live": "SELECT x.external_reference, t.id FROM xwalk x JOIN tgt_account t ON CAST(t.id AS VARCHAR) = x.target_id",
        "tried": "SELECT g.*, l.id AS live_id, CASE WHEN l.id IS NULL THEN (SELECT min(t.id) FROM tgt_account t WHERE t.name = "
                 "g.name AND t.segment = g.segment AND t.balance = g.balance AND (g.nation_id IS NULL OR t.nation_id = g.nation_id)) END "
                 "AS match_id FROM good g LEFT JOIN live l USING "
                 "(external_reference)",
        "groups": "SELECT name, segment, balance, nation_id, min(external_reference) AS ref FROM tried WHERE live_id IS NULL AND match_id IS "
                  "NULL GROUP BY ALL",
        "numbered": "SELECT *, 10000000 - 1 + row_number() OVER (ORDER BY ref) AS new_id FROM groups",
        "ids": "SELECT t.*, COALESCE(live_id, match_id, new_id) AS account_id, live_id IS NOT NULL OR n.ref = "
               "t.external_reference AS writes FROM tried t LEFT JOIN numbered n ON live_id IS NULL AND match_id IS NULL AND "
               "n.name = t.name AND n.segment = t.segment AND n.balance = t.balance AND n.nation_id IS NOT DISTINCT FROM t.nation_id",
        "accounts": "SELECT COALESCE(t.id, i.account_id) AS id, CASE WHEN i.account_id IS NULL THEN t.name ELSE i.name END AS name, "
                    "CASE WHEN i.account_id IS NULL THEN t.segment ELSE i.segment END AS segment, COALESCE(i.nation_id, "
                    "t.nation_id) AS nation_id, CASE WHEN i.account_id IS NULL THEN t.balance ELSE i.balance END AS balance FROM "
                    "tgt_account t FULL OUTER JOIN (SELECT * FROM ids WHERE writes) i ON t.id = i.account_id",
    }


_GOOD_COLUMNS = (f"external_reference, c_custkey, substr({STRIP_SQL}, 1, 12) AS name, {REMAP_SQL} AS segment, CASE WHEN "
                 "c_nationkey <> 7 THEN c_nationkey END AS nation_id, CAST(opened_on AS TIMESTAMP) AS opened")
_LAST = ("CASE WHEN c_custkey % 9 = 0 THEN c_acctbal + 7 WHEN c_custkey % 4 = 0 THEN c_acctbal + 5 ELSE c_acctbal END AS balance")
_EVENT_SQL = _job_sql(f"SELECT {_GOOD_COLUMNS}, {_LAST} FROM keyed_customer WHERE {_VALID} AND c_custkey % 6 <> 5")
_INPUTS = ("keyed_customer", "xwalk", "tgt_account")


@query("k4_event_delivery", sql("SELECT * FROM accounts", *_INPUTS, extra=_EVENT_SQL))
def event_delivery(spark, folder):
    return _delivered(spark, folder).target.tables["account"]


@query("k4_delivered_details", sql(
    "SELECT row_number() OVER (ORDER BY external_reference) AS id, account_id, balance, opened FROM ids", *_INPUTS,
    extra=_EVENT_SQL))
def delivered_details(spark, folder):
    return _delivered(spark, folder).target.tables["account_detail"]


@query("k4_event_outcomes", sql(
    "SELECT c_custkey * 10 + number AS event_id, CASE WHEN c_custkey % 6 = 5 THEN 'processing' WHEN valid THEN 'delivered' ELSE "
    "'quarantined' END AS status, CASE WHEN c_custkey % 6 <> 5 AND valid THEN 1 ELSE 0 END AS attempts, CASE WHEN c_custkey % 6 <> 5 "
    f"THEN {AS_OF_SQL} END AS processed_at, CASE WHEN c_custkey % 6 <> 5 AND NOT valid THEN 'VALIDATION' END AS last_error_code "
    "FROM ev", "keyed_customer", extra={"ev": " UNION ALL ".join(
        f"SELECT c_custkey, {n} AS number, {_VALID} AS valid FROM keyed_customer WHERE {c}" for n, c, _, _ in _EVENTS.values())}))
def event_outcomes(spark, folder):
    return _delivered(spark, folder).outbox.select("event_id", "status", "attempts", "processed_at", "last_error_code")


def _refreshed(spark, folder):
    customers = table(spark, folder, "customer").filter("c_custkey % 3 = 0")
    owned = customers.selectExpr("50000000 + c_custkey AS id", "1000 + c_custkey AS account_id", "c_acctbal AS balance",
                                 "CAST(NULL AS TIMESTAMP_NTZ) AS opened")
    native = table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS id", "s_suppkey AS account_id", "s_acctbal AS balance", "CAST(NULL AS TIMESTAMP_NTZ) AS opened")
    state = _state(spark, folder, owned.unionByName(native))
    links = crosswalk(spark, folder).withColumns({
        "target_table": F.lit("account_detail"),
        "target_id": (F.col("target_id").cast("bigint") + 50_000_000 - 1000).cast("string")})
    state.crosswalk = state.crosswalk.unionByName(links)
    return delivery.refresh_entity(fixture(spark, folder, "src_customer").drop("code_txt"), state, CUSTOMER, MODEL, PROFILE,
                                   SYSTEM, as_of())


_REFRESH_SQL = _job_sql(f"SELECT {_GOOD_COLUMNS}, c_acctbal AS balance FROM keyed_customer WHERE {_VALID}")


@query("k5_entity_refresh", sql(
    "SELECT s_suppkey AS id, s_suppkey AS account_id, s_acctbal AS balance, NULL::TIMESTAMP AS opened FROM supplier UNION ALL "
    "SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY external_reference), account_id, balance, opened "
    "FROM ids", *_INPUTS, extra=_REFRESH_SQL))
def entity_refresh(spark, folder):
    return _refreshed(spark, folder)[0].tables["account_detail"]


@query("k5_refresh_summary", sql(
    f"SELECT 'deleted account_detail' AS part, count(*) AS rows FROM xwalk UNION ALL SELECT 'failed', count(*) FROM keyed_customer "
    f"WHERE NOT ({_VALID}) UNION ALL SELECT 'written', count(*) FROM good UNION ALL SELECT 'unresolved', count(*) FROM "
    f"keyed_customer WHERE {_VALID} AND c_nationkey = 7", *_INPUTS, extra=_REFRESH_SQL))
def refresh_summary(spark, folder):
    state, failed, deleted = _refreshed(spark, folder)
    mine = (F.col("source_entity") == "customer") & (F.col("target_table") == "account_detail")
    counts = deleted.select(F.concat(F.lit("deleted "), "target_table").alias("part"), F.col("deleted").alias("rows"))
    for name, frame in (("failed", failed), ("written", state.crosswalk.filter(mine)), ("unresolved", state.unresolved)):
        counts = counts.unionByName(frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows"))
    return counts


ORDER_MODEL = TargetContract((
    MODEL.table("account"),
    TableContract("order_head", (
        ColumnContract("id", "bigint", nullable=False, primary_key=True, generated=True), ColumnContract("account_id", "bigint"),
        ColumnContract("status", "varchar(1)", nullable=False, enum_values=("F", "O", "P")), ColumnContract("total", "double"),
        ColumnContract("placed", "timestamp")), (ForeignKey("account_id", "account"),)),
    TableContract("order_note", (
        ColumnContract("id", "bigint", nullable=False, primary_key=True, generated=True),
        ColumnContract("head_id", "bigint", nullable=False), ColumnContract("priority", "varchar(6)")),
        (ForeignKey("head_id", "order_head"),)),
))
ORDERS = delivery.Entity("orders", SCHEMA, ("o_orderkey",), (
    FieldMapping("o_custkey", "order_head", "account_id"), FieldMapping("o_orderstatus", "order_head", "status"),
    FieldMapping("o_totalprice", "order_head", "total"), FieldMapping("o_orderdate", "order_head", "placed"),
    FieldMapping("o_orderpriority", "order_note", "priority"),
), references={"account": ("customer",)})


def _orders_refreshed(spark, folder):
    state = delivery.TargetState({
        "account": tgt_account(spark, folder),
        "order_head": spark.createDataFrame([], "id bigint, account_id bigint, status string, total double, placed timestamp_ntz"),
        "order_note": spark.createDataFrame([], "id bigint, head_id bigint, priority string"),
    }, crosswalk(spark, folder))
    return delivery.refresh_entity(table(spark, folder, "orders"), state, ORDERS, ORDER_MODEL, PROFILE, SYSTEM)[0]


_ORDER_IDS = {"o": f"SELECT *, row_number() OVER (ORDER BY {reference_sql('orders', 'o_orderkey')}) AS id FROM orders"}


@query("k5_order_refresh", sql(
    "SELECT o.id, t.id AS account_id, o_orderstatus AS status, o_totalprice AS total, o_orderdate AS placed FROM o LEFT JOIN "
    "tgt_account t ON t.id = 1000 + o_custkey", "tgt_account", extra=_ORDER_IDS))
def order_refresh(spark, folder):
    return _orders_refreshed(spark, folder).tables["order_head"]


@query("k5_order_notes", sql(
    "SELECT id, id AS head_id, substr(o_orderpriority, 1, 6) AS priority FROM o", extra=_ORDER_IDS))
def order_notes(spark, folder):
    return _orders_refreshed(spark, folder).tables["order_note"]


@query("k6_full_rebuild", sql(
    f"SELECT 'account' AS name, count(DISTINCT (substr({STRIP_SQL}, 1, 12), {REMAP_SQL}, c_acctbal, CASE WHEN c_nationkey <> 7 THEN c_nationkey END)) AS rows, 'delivered' AS state FROM "
    f"src_customer WHERE {_VALID} UNION ALL SELECT 'account_detail', count(*), 'delivered' FROM src_customer WHERE {_VALID} "
    "UNION ALL SELECT 'nation', count(*), 'kept' FROM nation UNION ALL SELECT 'supplier', count(*), 'failed' FROM supplier",
    "src_customer"))
def full_rebuild(spark, folder):
    broken = delivery.Entity("supplier", SCHEMA, ("s_suppkey",), (FieldMapping("no_such_column", "account", "name"),))
    sources = {"customer": fixture(spark, folder, "src_customer"), "supplier": table(spark, folder, "supplier")}
    empty = delivery.TargetState(
        {"account": tgt_account(spark, folder).limit(0), "account_detail": spark.createDataFrame([], _DETAIL),
         "nation": table(spark, folder, "nation").select("n_nationkey", "n_name")}, _nation_links(spark, folder))
    state, report = delivery.rebuild_target(sources, [broken, CUSTOMER], empty, MODEL, PROFILE, SYSTEM,
                                            lambda _, state: delivery.durable(state))
    states = {"account": report["customer"], "account_detail": report["customer"], "nation": "kept",
              "supplier": report["supplier"].split(":")[0]}
    frames = {**{n: state.tables[n] for n in ("account", "account_detail", "nation")}, "supplier": sources["supplier"]}
    rows = None
    for name, frame in frames.items():
        one = frame.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("name"), "rows", F.lit(states[name]).alias("state"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("k6_rebuilt_contents", sql(
    f"SELECT substr({STRIP_SQL}, 1, 12) AS name, {REMAP_SQL} AS segment, CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS nation_id, c_acctbal AS "
    f"balance, CAST(opened_on AS TIMESTAMP) AS opened FROM src_customer WHERE {_VALID}", "src_customer"))
def rebuilt_contents(spark, folder):
    """Accounts with their details after a rebuild in which another entity fails while its rows are read."""
    broken = delivery.Entity("supplier", SCHEMA, ("s_suppkey",), (FieldMapping("opened_on", "account_detail", "opened"),))
    # One row that is no date: nothing shows that before a task reads it.
    suppliers = table(spark, folder, "supplier").withColumn("opened_on", F.expr(
        "CAST(CASE WHEN s_suppkey = 5 THEN s_name ELSE '2020-01-01' END AS DATE)"))
    sources = {"customer": fixture(spark, folder, "src_customer"), "supplier": suppliers}
    empty = delivery.TargetState(
        {"account": tgt_account(spark, folder).limit(0), "account_detail": spark.createDataFrame([], _DETAIL),
         "nation": table(spark, folder, "nation").select("n_nationkey", "n_name")}, _nation_links(spark, folder))
    state, report = delivery.rebuild_target(sources, [CUSTOMER, broken], empty, MODEL, PROFILE, SYSTEM,
                                            lambda _, state: delivery.durable(state))
    failed = F.lit(report["supplier"].startswith("failed") and report["customer"] == "delivered")
    details = state.tables["account_detail"].select(F.col("account_id").alias("id"), "opened", F.col("balance").alias("_balance"))
    return details.filter(failed).join(state.tables["account"], "id").filter("balance = _balance").select(
        "name", "segment", "nation_id", "balance", "opened")


def first_delivery(spark: SparkSession, folder: str) -> DataFrame:
    """Reference, mapping, checks, crosswalk, new ids and the fan-out to two tables, in one plan."""
    rows = keyed_customer(spark, folder)
    staged = delivery.stage_rows(rows, CUSTOMER, MODEL, ["external_reference"], as_of())
    good, _ = validation.split(staged)
    links = lookups.entity_crosswalk(crosswalk(spark, folder), "customer", TARGET, "account")
    known = materialise(good.join(links, "external_reference", "left"))
    fresh = ordering.allocate_ids(known.filter("target_id IS NULL").drop("target_id"), "external_reference", "target_id",
                                  PROFILE.id_start)
    settled = known.filter("target_id IS NOT NULL").withColumn("target_id", F.col("target_id").cast("bigint"))
    # Both target rows come from one source row, so the parent id is at hand without a join.
    return union_all(settled, fresh).select(
        "external_reference", F.col("target_id").alias("id"), "account.name", "account.segment",
        F.col("target_id").alias("account_id"), "account_detail.balance", "account_detail.opened")


@query("entry_first_delivery", sql(
    "SELECT external_reference, id, name, segment, id AS account_id, balance, opened FROM (SELECT *, COALESCE(CAST(target_id AS "
    "BIGINT), 10000000 - 1 + row_number() OVER (PARTITION BY target_id IS NULL ORDER BY external_reference)) AS id FROM g)",
    "keyed_customer", "xwalk", extra={
        "g": f"SELECT c.external_reference, substr({STRIP_SQL}, 1, 12) AS name, {REMAP_SQL} AS segment, c_acctbal AS balance, "
             "CAST(opened_on AS TIMESTAMP) AS opened, x.target_id FROM keyed_customer c LEFT JOIN xwalk x ON "
             f"c.external_reference = x.external_reference WHERE {_VALID}"}))
def entry_first_delivery(spark, folder):
    return first_delivery(spark, folder)
