"""Sources, sinks and keyed merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import ColumnContract, ForeignKey, TableContract, TargetContract
from ..operators import merge
from ..operators.projection import coerce_rows, empty_target
from ..operators.union import union_all
from ..sources import contracts as contract_sources
from ..sources import tables, targets
from ..sources.snapshots import Snapshots, rebuild
from ..sources.workspace import shared_folder
from .fixtures import ACCOUNT, NATION, as_of, crosswalk, keyed_customer, outbox, sql, table, tgt_account
from .registry import query

RELATIONAL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
COUNTED = (*RELATIONAL, "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("a1_table_scan", "SELECT * FROM lineitem")
def table_scan(spark, folder):
    return tables.scan(spark, f"{folder}/lineitem.parquet")


@query("a2_pruned_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def pruned_scan(spark, folder):
    return tables.scan(spark, f"{folder}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("a3_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in COUNTED))
def row_counts(spark, folder):
    return tables.row_counts({t: table(spark, folder, t) for t in COUNTED})


@query("a4_incremental_poll", "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def incremental_poll(spark, folder):
    return tables.since(table(spark, folder, "events"), "ts", F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))


@query("a5_change_feed", sql(
    "SELECT event_id, external_reference, operation, payload, created_at FROM outbox "
    "WHERE source_entity = 'click' AND created_at > TIMESTAMP '2024-01-10 00:00:00'", "outbox"))
def change_feed(spark, folder):
    feed = tables.feed_since(outbox(spark, folder), "click", F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    return feed.select("event_id", "external_reference", "operation", "payload", "created_at")


# Columns of the given tables with the types of a contract, as the SQL cannot look them up.
_TYPES = {
    "region": {"r_regionkey": "integer", "r_name": "string"},
    "nation": {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "integer"},
    "customer": {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float",
                 "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "float"},
    "part": {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer",
             "p_retailprice": "float"},
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float",
               "o_orderdate": "datetime", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
                 "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "string",
                 "l_linestatus": "string", "l_shipdate": "datetime"},
    "events": {"event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "string", "value": "float", "props": "string"},
}
_PRIMARY = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
            "orders": "o_orderkey", "events": "event_id"}


@query("a7_contract_catalog", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{d}' AS data_type, true AS nullable, "
    f"{'true' if _PRIMARY.get(t) == c else 'false'} AS is_primary_key, count(*) AS rows FROM {t}"
    for t, cols in _TYPES.items() for i, (c, d) in enumerate(cols.items())))
def contract_catalog(spark, folder):
    frames = {t: table(spark, folder, t) for t in RELATIONAL}
    listed = contract_sources.from_schemas(spark, {t: df.schema for t, df in frames.items()}, _PRIMARY)
    return listed.join(tables.row_counts(frames), "table_name")


_REFERS = [("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"),
           ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"),
           ("lineitem", "l_suppkey", "supplier")]


@query("a7_foreign_keys", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{p}' AS ref_table, '{_PRIMARY[p]}' AS ref_column WHERE EXISTS (SELECT 1 FROM {t} "
    f"WHERE {c} IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {_PRIMARY[p]} FROM {p}))"
    for t, c, p in _REFERS))
def foreign_keys(spark, folder):
    """Found by their values, as files declare none."""
    return contract_sources.foreign_keys({t: table(spark, folder, t) for t in RELATIONAL}, _PRIMARY)


_DOCUMENT = (
    "'{\"tbl_' || CAST(p_partkey AS STRING) || '\":[{\"name\":\"id\",\"type\":\"BigInt\",\"nullable\":false,"
    "\"primary_key\":true},{\"name\":\"' || p_name || '\",\"type\":\"' || CASE p_partkey % 5 WHEN 0 THEN 'varchar(20)' "
    "WHEN 1 THEN 'TIMESTAMP with time zone' WHEN 2 THEN 'numeric(10,2)' WHEN 3 THEN 'tinyint' ELSE 'jsonb' END "
    "|| '\"}]}'"
)


@query("a8_json_contract", (
    "SELECT p_partkey, 'tbl_' || CAST(p_partkey AS VARCHAR) AS table_name, 0 AS position, 'id' AS column_name, "
    "'integer' AS data_type, false AS nullable, true AS is_primary_key FROM part UNION ALL "
    "SELECT p_partkey, 'tbl_' || CAST(p_partkey AS VARCHAR), 1, p_name, CASE p_partkey % 5 WHEN 0 THEN 'string' "
    "WHEN 1 THEN 'datetime' WHEN 2 THEN 'float' WHEN 3 THEN 'string' ELSE 'json' END, true, false FROM part"))
def json_contract(spark, folder):
    exports = table(spark, folder, "part").selectExpr("p_partkey", f"{_DOCUMENT} AS document")
    return contract_sources.from_export(exports, "document", "p_partkey")


@query("a9_batch_append", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def batch_append(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = shared_folder(spark)
    tables.append(rows.filter("o_totalprice < 200000"), path)
    tables.append(rows.filter("o_totalprice >= 200000"), path)
    return spark.read.schema(rows.schema).parquet(path)


_EVENT_STATE = "user_id, event_id, ts, value"


_NEWER = sql(
    "SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, "
    "incoming DESC, event_id DESC) AS n FROM rivals) WHERE n = 1", extra={
        "present": f"SELECT {_EVENT_STATE} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, "
                   "event_id DESC) AS n FROM events WHERE event_type <> 'click') WHERE n = 1",
        "batch": f"SELECT {_EVENT_STATE} FROM events WHERE event_type = 'click' UNION ALL "
                 "SELECT user_id, event_id + 100000000, ts, value + 1 FROM present WHERE user_id % 2 = 0",
        "rivals": "SELECT *, 0 AS incoming FROM present UNION ALL SELECT *, 1 AS incoming FROM batch",
    })


def _newer(spark, folder, small_batch):
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "value", "event_type")
    current = merge.first_per_key(events.filter("event_type <> 'click'"), ["user_id"],
                                  [F.col("ts").desc(), F.col("event_id").desc()]).drop("event_type")
    ties = current.filter("user_id % 2 = 0").selectExpr(
        "user_id", "event_id + 100000000 AS event_id", "ts", "value + 1 AS value")
    batch = union_all(events.filter("event_type = 'click'").drop("event_type"), ties)
    return merge.upsert_newer(current, batch, ["user_id"], "ts", ["event_id"], small_batch)


@query("a10_upsert_newer", _NEWER)
def upsert_newer(spark, folder):
    return _newer(spark, folder, False)


@query("a10_upsert_newer_small_batch", _NEWER)
def upsert_newer_small_batch(spark, folder):
    return _newer(spark, folder, True)


@query("a11_upsert_last", sql(
    "SELECT c_custkey, amount FROM current_rows WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL "
    "SELECT o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) "
    "AS n FROM orders) WHERE n = 1",
    extra={"current_rows": "SELECT c_custkey, c_acctbal AS amount FROM customer WHERE c_custkey % 4 <> 0"}))
def upsert_last(spark, folder):
    current = table(spark, folder, "customer").filter("c_custkey % 4 <> 0").selectExpr(
        "c_custkey", "c_acctbal AS amount")
    batch = table(spark, folder, "orders").selectExpr("o_custkey AS c_custkey", "o_totalprice AS amount", "o_orderkey")
    return merge.upsert_last(current, batch, ["c_custkey"], ["o_orderkey"])


_NATIVE = "SELECT 5000000 + s_suppkey AS id, s_name AS name FROM supplier"


def _delete(spark, folder):
    native = table(spark, folder, "supplier").selectExpr("5000000 + s_suppkey AS id", "s_name AS name")
    rows = tgt_account(spark, folder).select("id", "name").unionByName(native)
    nations = table(spark, folder, "nation").selectExpr("n_nationkey AS id", "n_name AS name")
    return merge.scoped_delete({"account": (rows, "id"), "nation": (nations, "id")}, crosswalk(spark, folder),
                               "customer", "CRM", ["nation"])


@query("a12_scoped_delete", sql(
    f"SELECT id, name FROM ({_NATIVE} UNION ALL SELECT id, name FROM tgt_account) WHERE CAST(id AS VARCHAR) NOT IN "
    "(SELECT target_id FROM xwalk)", "tgt_account", "xwalk"))
def scoped_delete(spark, folder):
    return _delete(spark, folder)[0]["account"]


@query("a12_deleted_counts", sql(
    "SELECT 'account' AS target_table, count(*) AS deleted FROM tgt_account WHERE CAST(id AS VARCHAR) IN "
    "(SELECT target_id FROM xwalk)", "tgt_account", "xwalk"))
def deleted_counts(spark, folder):
    return _delete(spark, folder)[2]


@query("a13_truncate_rebuild", sql(
    "SELECT 'account' AS table_name, id FROM tgt_account UNION ALL SELECT 'nation', n_nationkey FROM nation",
    "tgt_account"))
def truncate_rebuild(spark, folder):
    root = shared_folder(spark)
    names = {"account": table(spark, folder, "supplier").selectExpr("s_suppkey AS id"),
             "nation": table(spark, folder, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id")}
    stores = {n: Snapshots(spark, f"{root}/{n}") for n in names}
    for name, df in names.items():
        stores[name].publish(df)
    rebuild(stores, {n: df.limit(0) for n, df in names.items()}, {"nation"})
    fresh = stores["account"].current().unionByName(tgt_account(spark, folder).select("id"))
    stores["account"].publish(fresh)
    return stores["account"].current().select(F.lit("account").alias("table_name"), "id").unionByName(
        stores["nation"].current().select(F.lit("nation").alias("table_name"), "id"))


@query("a14_create_target", (
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey::BIGINT AS nation_id, "
    "c_acctbal AS balance FROM customer"))
def create_target(spark, folder):
    rows = table(spark, folder, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS id", "c_name AS name", "c_mktsegment AS segment",
        "CAST(c_nationkey AS STRING) AS nation_id", "CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) AS balance")
    path = shared_folder(spark)
    empty = empty_target(spark, ACCOUNT)
    empty.write.parquet(path)
    tables.append(coerce_rows(rows, ACCOUNT).drop("uncoerced"), path)
    return spark.read.schema(empty.schema).parquet(path)


_WHOLE = TargetContract((ACCOUNT, NATION, TableContract("account_detail", (
    ColumnContract("id", "bigint", nullable=False, primary_key=True), ColumnContract("account_id", "bigint", nullable=False),
    ColumnContract("balance", "double"), ColumnContract("parent_id", "bigint")),
    (ForeignKey("account_id", "account"), ForeignKey("parent_id", "account_detail")))))


def _loaded(spark, folder):
    """(created columns, rejected rows, folder) of a contract's tables filled with customers and their orders.

    Customers of nation 7 have no nation, every eleventh has no name, and every fifth comes twice; an order's parent is another order.
    """
    root = shared_folder(spark)
    created = targets.create(spark, _WHOLE, root)
    nations = table(spark, folder, "nation").filter("n_nationkey <> 7").select("n_nationkey", "n_name")
    accounts = table(spark, folder, "customer").selectExpr(
        "c_custkey AS id", "CASE WHEN c_custkey % 11 <> 0 THEN substr(c_name, 1, 12) END AS name", "c_mktsegment AS segment",
        "c_nationkey AS nation_id", "c_acctbal AS balance")
    again = accounts.filter("id % 5 = 0").withColumn("balance", F.col("balance") + 20000)
    details = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS account_id", "o_totalprice AS balance",
        "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey DIV 3 WHEN o_orderkey % 3 = 1 THEN -1 END AS parent_id")
    rejected = targets.load(spark, _WHOLE, root, {"account": union_all(accounts, again), "nation": nations, "account_detail": details},
                            {"account": ["balance"], "nation": ["n_name"], "account_detail": ["id"]})
    return created, rejected, root


_LET_IN = {
    "twice": "SELECT c_custkey, c_nationkey, c_custkey % 11 <> 0 AS named, false AS later FROM customer UNION ALL SELECT c_custkey, c_nationkey, "
             "c_custkey % 11 <> 0, true FROM customer WHERE c_custkey % 5 = 0",
    "good": "SELECT c_custkey FROM twice WHERE named AND c_nationkey <> 7 AND NOT later",
    "details": "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM good) AS owned, o_orderkey % 3 = 1 OR (o_orderkey % 3 = 0 AND o_orderkey // 3 "
               "NOT IN (SELECT o_orderkey FROM orders)) AS lost FROM orders",
    # An order whose parent is turned away has none.
    "bad": "WITH RECURSIVE b(id) AS (SELECT o_orderkey FROM details WHERE lost OR NOT owned UNION SELECT o_orderkey FROM details JOIN b ON "
           "o_orderkey % 3 = 0 AND o_orderkey // 3 = id) SELECT id FROM b",
}


@query("a14_created_tables", sql(
    "SELECT 'nation' AS table_name, 0::INTEGER AS wave, 2::BIGINT AS columns, 2::BIGINT AS required, 0::BIGINT AS refs, (SELECT count(*) FROM nation "
    "WHERE n_nationkey <> 7) AS rows UNION ALL SELECT 'account', 1, 5, 2, 1, (SELECT count(*) FROM good) UNION ALL SELECT 'account_detail', 2, 4, 2, "
    "2, (SELECT count(*) FROM details WHERE owned AND NOT lost AND o_orderkey NOT IN (SELECT id FROM bad))", extra=_LET_IN))
def created_tables(spark, folder):
    """Every table of a contract, with its wave, its constraints and the rows they let in."""
    created, _, root = _loaded(spark, folder)
    counts = tables.row_counts({t.name: targets.stored(spark, _WHOLE, root, t.name) for t in _WHOLE.tables})
    shape = created.groupBy("table_name", "wave").agg(F.count("*").alias("columns"), F.count_if(~F.col("nullable")).alias("required"),
                                                      F.count("ref_table").alias("refs"))
    return shape.join(counts, "table_name")


@query("a14_rejected_rows", sql(
    "SELECT table_name, errors, count(*) AS rows FROM (SELECT 'account' AS table_name, concat_ws('; ', CASE WHEN NOT named THEN 'name is null' "
    "END, CASE WHEN later THEN 'id is there already' END, CASE WHEN c_nationkey = 7 THEN 'nation_id has no row in nation' END) AS errors FROM twice "
    "UNION ALL SELECT 'account_detail', concat_ws('; ', CASE WHEN NOT owned THEN 'account_id has no row in account' END, CASE WHEN lost OR "
    "(owned AND o_orderkey IN (SELECT id FROM bad)) THEN 'parent_id has no row in account_detail' END) FROM details) WHERE errors <> '' GROUP BY ALL", extra=_LET_IN))
def rejected_rows(spark, folder):
    """What NOT NULL, key and foreign key turn away, with all reasons of a row."""
    _, rejected, _ = _loaded(spark, folder)
    return rejected.groupBy("table_name", F.array_join("errors", "; ").alias("errors")).agg(F.count("*").alias("rows"))


@query("g1_backfill_unseen", sql(
    "SELECT external_reference, 'backfill' AS operation FROM keyed_customer WHERE external_reference NOT IN "
    "(SELECT external_reference FROM xwalk)", "keyed_customer", "xwalk"))
def backfill_unseen(spark, folder):
    rows = keyed_customer(spark, folder)
    fresh = merge.unseen(rows, crosswalk(spark, folder), ["external_reference"])
    return fresh.select("external_reference", F.lit("backfill").alias("operation"))


@query("g1_backfill_counts", sql(
    "SELECT count(*) FILTER (WHERE x.external_reference IS NULL) AS queued, "
    "count(*) FILTER (WHERE x.external_reference IS NOT NULL) AS skipped, count(*) AS total_source_rows "
    "FROM keyed_customer c LEFT JOIN xwalk x ON c.external_reference = x.external_reference",
    "keyed_customer", "xwalk"))
def backfill_counts(spark, folder):
    seen = crosswalk(spark, folder).select("external_reference", F.lit(True).alias("seen"))
    rows = keyed_customer(spark, folder).select("external_reference").join(seen, "external_reference", "left")
    return rows.agg(F.count_if(F.col("seen").isNull()).alias("queued"), F.count_if("seen").alias("skipped"),
                    F.count("*").alias("total_source_rows"))


@query("g2_insert_if_absent", (
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL "
    "SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 10 = 0"))
def insert_if_absent(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    present = orders.filter("o_orderkey % 10 <> 0")
    batch = orders.withColumn("o_orderstatus", F.lit("X"))
    return merge.insert_absent(present, batch.unionByName(batch), ["o_orderkey"])


@query("g3_added_removed_common", (
    "SELECT COALESCE(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' "
    "ELSE 'common' END AS side FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 0) a FULL OUTER JOIN "
    "(SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 1) b ON a.k = b.k"))
def added_removed_common(spark, folder):
    orders = table(spark, folder, "orders")
    return merge.split_sets(orders.filter("o_orderkey % 10 <> 0"), orders.filter("o_orderkey % 10 <> 1"),
                            ["o_orderkey"])


_ORDER_JSON = ("'{\"o_orderkey\":' || CAST(o_orderkey AS VARCHAR) || ',\"o_orderstatus\":\"' || o_orderstatus || "
               "'\",\"o_totalprice\":' || CAST(o_totalprice AS VARCHAR) || '}'")
_SNAPSHOTS = {
    "s0": f"SELECT o_orderkey, {_ORDER_JSON} AS js FROM orders WHERE o_orderkey % 10 <> 0",
    "s1": f"SELECT o_orderkey, {_ORDER_JSON} AS js FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' "
          "ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 1)",
    "diff": "SELECT COALESCE(s0.o_orderkey, s1.o_orderkey) AS o_orderkey, CASE WHEN s0.js IS NULL THEN 'insert' "
            "WHEN s1.js IS NULL THEN 'deactivate' WHEN s0.js <> s1.js THEN 'update' END AS operation, "
            "CASE WHEN s1.js IS NULL THEN substr(s0.js, 1, length(s0.js) - 1) || ',\"active\":false,\"deactivated_at\":"
            "\"2024-01-15 00:00:00\"}' ELSE s1.js END AS payload "
            "FROM s0 FULL OUTER JOIN s1 ON s0.o_orderkey = s1.o_orderkey",
}


@query("h11_snapshot_diff", sql(
    "SELECT o_orderkey, operation, payload, sha256(payload) AS payload_checksum FROM diff WHERE operation IS NOT NULL",
    extra=_SNAPSHOTS))
def snapshot_diff(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = orders.filter("o_orderkey % 10 <> 1").withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return merge.snapshot_changes(orders.filter("o_orderkey % 10 <> 0"), after, ["o_orderkey"], as_of())
