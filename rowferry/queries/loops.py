"""The delivery loop as a stream, drained until nothing is due."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import FieldMapping, TargetContract, TargetProfile
from ..functions.keys import reference_for, row_json
from ..operators.union import union_all
from ..plans import delivery
from ..sources.workspace import shared_folder
from ..streaming import delivering, feeds
from ..streaming.commits import Commits
from .fixtures import (
    ACCOUNT, ACCOUNT_DETAIL, NATION, REMAP_SQL, SCHEMA, STRIP_SQL, SYSTEM, TARGET, as_of, keyed_customer, sql, table, tgt_account,
)
from .jobs import _DETAIL, CUSTOMER, ORDER_MODEL, ORDERS, ROW, _nation_links
from .outcomes import _BAD, _HELD, _LETTERS, _SWITCH, _events
from .registry import query
from .streams import feed_files

# Customers bring the ids of their accounts, so that ids do not depend on how events fall into passes.
_CUSTOMER = replace(CUSTOMER, mappings=(*CUSTOMER.mappings, FieldMapping("c_custkey", "account", "id")))
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_MODEL = TargetContract((ACCOUNT, ACCOUNT_DETAIL, NATION, *[t for t in ORDER_MODEL.tables if t.name != "account"]))
_PROFILE = TargetProfile(TARGET, lookup_tables=frozenset({"nation"}))
_AUDIT = "event_id bigint, attempt int, outcome string, response_code string"
_TABLES = ("account", "account_detail", "nation", "order_head", "order_note")
PASS = 10_000
"""Events that a worker claims."""
SHARE = 0.75
"""Share of the due events that the workers of a pass claim together, where that is more than one worker claims."""


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a table dealt to all tasks before events are made of them, as events are long and costly to make."""
    return rows.repartition(feed_files(rows.sparkSession))


def _feed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events of customers, with words for balances, later events of single columns and repeats; then those of their orders."""
    rows = _spread(keyed_customer(spark, folder))
    changed = rows.withColumn("c_acctbal", F.col("c_acctbal") + 3)
    whole = row_json(changed, ROW.fieldNames())
    wrong = F.regexp_replace(whole, '"c_acctbal":[^,}]*', '"c_acctbal":"abc"')
    first = _events(changed, "customer", "c_custkey * 8", F.when(F.col("c_custkey") % 5 == 1, wrong).otherwise(whole))
    moved = rows.filter("c_custkey % 4 = 0").withColumn("c_mktsegment", F.lit("AUTOMOBILE"))
    at = F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'")
    later = _events(moved, "customer", "c_custkey * 8 + 1", row_json(moved, ["c_mktsegment"])).withColumns(
        {"created_at": at, "source_updated_at": at})
    customers = union_all(first, later).withColumn("attempts", F.lit(0))
    orders = _spread(table(spark, folder, "orders").select(*_ORDER_COLUMNS))
    orders = orders.withColumn("external_reference", reference_for(orders, SYSTEM, SCHEMA, "orders", ["o_orderkey"]))
    heads = _events(orders, "orders", "10000000000 + o_orderkey", row_json(orders, _ORDER_COLUMNS)).withColumns(
        {"created_at": at + F.make_dt_interval(F.lit(1)), "attempts": F.lit(0)})
    return union_all(customers, customers.filter("event_id % 3 = 0")), heads


def looped(spark: SparkSession, folder: str, limit: int = PASS, again: bool = False) -> Commits:
    """The loop's tables after the feed is drained and nothing is due; with `again` every batch comes twice."""
    parts = _feed(spark, folder)
    state = delivery.TargetState({
        "account": tgt_account(spark, folder).limit(0), "account_detail": spark.createDataFrame([], _DETAIL),
        "nation": table(spark, folder, "nation").select("n_nationkey", "n_name"),
        "order_head": spark.createDataFrame([], "id bigint, account_id bigint, status string, total double, placed timestamp_ntz"),
        "order_note": spark.createDataFrame([], "id bigint, head_id bigint, priority string"),
    }, _nation_links(spark, folder))
    commits = delivering.store(spark, shared_folder(spark), _MODEL, _TABLES)
    delivering.begin(commits, state, {
        "outbox": parts[0].limit(0), "quarantine": spark.createDataFrame([], _HELD), "envelope": spark.createDataFrame([], _LETTERS),
        "audit": spark.createDataFrame([], _AUDIT)})
    switch = spark.createDataFrame([("customer", TARGET, True), ("orders", TARGET, True)], _SWITCH)
    entities = [_CUSTOMER, replace(ORDERS, row_schema=table(spark, folder, "orders").select(*_ORDER_COLUMNS).schema)]
    once = delivering.pass_over(commits, switch, entities, _MODEL, _PROFILE, SYSTEM, as_of, limit, SHARE)

    def handle(rows: DataFrame, batch: int) -> None:
        once(rows, batch)
        if again:
            once(rows, batch)

    path, checkpoint = shared_folder(spark), shared_folder(spark)
    for part in parts:
        part.coalesce(feed_files(spark)).write.mode("append").parquet(path)
        ahead = True
        while ahead:  # the heartbeat gives every drain a batch, with new files or without
            feeds.drain(feeds.with_heartbeat(feeds.read_feed(spark, path, part.schema)), handle, checkpoint)
            ahead = delivering.work_off(commits, switch, as_of())
    return commits


def _keys(commits: Commits, spark: SparkSession, folder: str, entity: str, name: str, key: str) -> DataFrame:
    """Source keys of a target table's ids."""
    links = commits.read()[delivering._CROSSWALK].filter((F.col("source_entity") == entity) & (F.col("target_table") == name))
    source = table(spark, folder, entity).select(key)
    named = source.withColumn("external_reference", reference_for(source, SYSTEM, SCHEMA, entity, [key]))
    return links.join(named, "external_reference").select(F.col("target_id").cast("bigint").alias("id"), F.col(key).alias("key"))


_GOOD = {"g": f"SELECT c_custkey, substr({STRIP_SQL}, 1, 12) AS name, CASE WHEN c_custkey % 4 = 0 THEN 'AUTO' ELSE {REMAP_SQL} END AS segment, "
              f"c_acctbal + 3 AS balance, NOT {_BAD} AS good FROM keyed_customer"}


@query("j1_delivery_loop", sql(
    "SELECT 'account' AS part, c_custkey AS key, name || '|' || segment AS text, balance AS amount, NULL::BIGINT AS link FROM g WHERE good "
    "UNION ALL SELECT 'order_head', o_orderkey, o_orderstatus, o_totalprice, CASE WHEN good THEN c_custkey END FROM orders LEFT JOIN g ON "
    "c_custkey = o_custkey", "keyed_customer", extra=_GOOD))
def delivery_loop(spark, folder):
    """Target tables of a loop that claims a limited number of events per pass."""
    commits = looped(spark, folder)
    now = commits.read()
    accounts = now["account"].join(_keys(commits, spark, folder, "customer", "account", "c_custkey"), "id").select(
        F.lit("account").alias("part"), "key", F.concat_ws("|", "name", "segment").alias("text"), F.col("balance").alias("amount"),
        F.lit(None).cast("bigint").alias("link"))
    heads = now["order_head"].join(_keys(commits, spark, folder, "orders", "order_head", "o_orderkey"), "id").select(
        F.lit("order_head").alias("part"), "key", F.col("status").alias("text"), F.col("total").alias("amount"), F.col("account_id").alias("link"))
    return union_all(accounts, heads)


@query("j1_loop_outcomes", sql(
    "SELECT 'customer' AS source_entity, CASE WHEN good THEN 'delivered' ELSE 'quarantined' END AS status, count(*) AS events, count(*) "
    "FILTER (good) AS accepted FROM g GROUP BY ALL UNION ALL SELECT 'customer later', CASE WHEN good THEN 'delivered' ELSE 'retry' END, "
    "count(*), count(*) FILTER (good) FROM g WHERE c_custkey % 4 = 0 GROUP BY ALL UNION ALL SELECT 'orders', 'delivered', count(*), count(*) FROM "
    "orders", "keyed_customer", extra=_GOOD))
def loop_outcomes(spark, folder):
    """Every event once in the outbox and, where a pass delivered it, once in the audit."""
    now = looped(spark, folder).read()
    accepted = now["audit"].filter("outcome = 'accepted'").groupBy("event_id").agg(F.count("*").alias("n"))
    kind = F.when((F.col("source_entity") == "customer") & (F.col("event_id") % 8 == 1), "customer later").otherwise(F.col("source_entity"))
    return now["outbox"].join(accepted, "event_id", "left").groupBy(kind.alias("source_entity"), "status").agg(
        F.count("*").alias("events"), F.coalesce(F.sum("n"), F.lit(0)).alias("accepted"))
