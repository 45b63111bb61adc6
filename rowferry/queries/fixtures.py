"""Inputs the queries derive from the given tables, once as frames and once as SQL.

Each fixture is a list of portable SQL expressions over one table, so both sides start from the same
rows; what a query then does with them is written twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import ColumnContract, ForeignKey, TableContract, TargetContract
from ..functions.keys import NAMESPACE, reference_for

SYSTEM, SCHEMA, TARGET = "SRC", "erp", "CRM"
AS_OF_SQL = "TIMESTAMP '2024-01-15 00:00:00'"


def as_of() -> Column:
    return F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def uuid5_sql(name: str) -> str:
    digest = f"sha1(from_hex('{NAMESPACE.replace('-', '')}') || encode({name}))"
    return (
        f"(substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || "
        f"translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({digest}, 18, 3) "
        f"|| '-' || substr({digest}, 21, 12))"
    )


def reference_sql(entity: str, key: str) -> str:
    return uuid5_sql(f"'{SYSTEM}|{SCHEMA}|{entity}|' || CAST({key} AS VARCHAR)")


# name -> (table, expressions, condition)
FIXTURES: dict[str, tuple[str, list[str], str | None]] = {
    "src_customer": ("customer", [
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment",
        "CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN '  ' || c_name || ' ' || chr(9) "
        "WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END AS c_name",
        "CASE c_custkey % 5 WHEN 0 THEN ' ' || CAST(c_custkey AS STRING) || ' ' WHEN 1 THEN '12.5' WHEN 2 THEN 'abc' "
        "WHEN 3 THEN '' ELSE CAST(c_custkey AS STRING) END AS code_txt",
        "DATE '2020-01-01' + CAST(c_custkey % 700 AS INT) AS opened_on",
    ], None),
    "outbox_base": ("events", [
        "event_id", "event_type AS source_entity", "user_id",
        "CASE event_id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'deactivate' ELSE 'backfill' END "
        "AS operation",
        "props AS payload",
        "CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'retry' WHEN 2 THEN 'processing' WHEN 3 THEN 'delivered' "
        "WHEN 4 THEN 'quarantined' ELSE 'dead_letter' END AS status",
        "CAST(event_id % 9 AS INT) AS attempts", "ts + (event_id % 3) * INTERVAL '1' DAY AS available_at",
        "ts AS source_updated_at", "ts AS created_at",
        "CASE WHEN event_id % 6 >= 3 AND event_id % 5 <> 0 THEN ts + INTERVAL '1' HOUR END AS processed_at",
        "CASE WHEN event_id % 6 = 1 THEN 'TRANSPORT' END AS last_error_code",
        "CASE WHEN event_id % 6 = 1 THEN 'connection lost' END AS last_error_message",
    ], None),
    "catalog_v1": ("part", [
        "'tbl_' || CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS STRING) AS table_name",
        "CAST(p_partkey % 8 AS INT) AS position",
        "replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 8 AS STRING) AS column_name",
        "CASE p_type WHEN 'ECONOMY' THEN 'integer' WHEN 'PROMO' THEN 'float' WHEN 'STANDARD' THEN 'datetime' "
        "ELSE 'string' END AS data_type",
        "p_size % 2 = 0 AND p_partkey % 8 <> 0 AS nullable", "p_partkey % 8 = 0 AS is_primary_key",
    ], None),
    "catalog_v2_kept": ("part", [
        "CASE WHEN CAST(floor(p_partkey / 8) AS BIGINT) % 10 = 8 THEN 'new_' ELSE 'tbl_' END || "
        "CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS STRING) AS table_name",
        "CAST(p_partkey % 8 AS INT) AS position",
        "replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 8 AS STRING) AS column_name",
        "CASE WHEN p_partkey % 19 = 2 THEN 'text' WHEN p_type = 'ECONOMY' THEN 'integer' WHEN p_type = 'PROMO' "
        "THEN 'float' WHEN p_type = 'STANDARD' THEN 'datetime' ELSE 'string' END AS data_type",
        "CASE WHEN p_partkey % 23 = 5 THEN NOT (p_size % 2 = 0 AND p_partkey % 8 <> 0) "
        "ELSE p_size % 2 = 0 AND p_partkey % 8 <> 0 END AS nullable",
        "CASE WHEN p_partkey % 31 = 8 THEN p_partkey % 8 <> 0 ELSE p_partkey % 8 = 0 END AS is_primary_key",
    ], "p_partkey % 17 <> 3 AND CAST(floor(p_partkey / 8) AS BIGINT) % 10 <> 9"),
    "catalog_v2_extra": ("part", [
        "CASE WHEN CAST(floor(p_partkey / 8) AS BIGINT) % 10 = 8 THEN 'new_' ELSE 'tbl_' END || "
        "CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS STRING) AS table_name",
        "CAST(100 + p_partkey % 8 AS INT) AS position",
        "'extra_' || CAST(p_partkey % 8 AS STRING) AS column_name",
        "'string' AS data_type", "p_partkey % 2 = 0 AS nullable", "false AS is_primary_key",
    ], "p_partkey % 29 = 4 AND CAST(floor(p_partkey / 8) AS BIGINT) % 10 <> 9"),
    "entities": ("supplier", [
        "'ent_' || CAST(s_suppkey AS STRING) AS source_entity", "s_suppkey",
        "CASE WHEN s_suppkey % 7 = 0 THEN 'paused' ELSE 'deployed' END AS status",
    ], None),
    "foot_0": ("supplier", ["'ent_' || CAST(s_suppkey AS STRING) AS source_entity",
                            "'tbl_' || CAST(s_suppkey AS STRING) AS table_name"], None),
    "foot_1": ("supplier", ["'ent_' || CAST(s_suppkey AS STRING) AS source_entity",
                            "'tbl_' || CAST(s_suppkey + 1 AS STRING) AS table_name"], None),
    "foot_2": ("supplier", ["'ent_' || CAST(s_suppkey AS STRING) AS source_entity",
                            "'tbl_' || CAST(2 * s_suppkey AS STRING) AS table_name"], "s_suppkey % 2 = 1"),
    "proposals": ("part", [
        "'ent_' || CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS STRING) AS source_table",
        "'src_' || CAST(p_partkey % 8 AS STRING) AS source_column",
        "'tbl_' || CAST(CAST(floor(p_partkey / 8) AS BIGINT) AS STRING) AS target_table",
        "CASE WHEN p_partkey % 13 = 6 THEN NULL WHEN p_partkey % 13 = 7 THEN '?' ELSE replace(p_name, ' ', '_') || '_' "
        "|| CAST(p_partkey % 8 AS STRING) END AS target_column",
        "CAST(p_partkey % 21 AS DOUBLE) / 20 AS confidence",
    ], None),
    "error_log": ("events", [
        "event_id AS error_id", "'ent_' || CAST(user_id % 50 AS STRING) AS source_entity",
        "CASE event_id % 8 "
        "WHEN 0 THEN 'duplicate key value violates unique constraint \"account_pkey\" DETAIL: Key (id)=(' || "
        "CAST(user_id AS STRING) || ') already exists.' "
        "WHEN 1 THEN 'Duplicate entry ''' || CAST(user_id AS STRING) || ''' for key ''account.PRIMARY''' "
        "WHEN 2 THEN 'Duplicate entry ''' || CAST(user_id AS STRING) || ''' for key ''account_pkey''' "
        "WHEN 3 THEN 'no row in reference table nation matches {''n_name'': ''X' || CAST(user_id AS STRING) || '''}' "
        "WHEN 4 THEN 'nation.id=' || CAST(user_id AS STRING) || ' does not exist; nation is read-only' "
        "WHEN 5 THEN 'mapping cannot be deployed: - account.name is required but no source column maps to it "
        "- account.id is required but no source column maps to it' "
        "WHEN 6 THEN 'account.opened date year ' || CAST(10000 + user_id AS STRING) || ' is outside supported range' "
        "ELSE 'job 0f8fad5b-d9cb-469f-a165-70867728950e lost its connection' END AS error",
    ], None),
}


def fixture(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, expressions, condition = FIXTURES[name]
    df = table(spark, folder, source)
    if condition:
        df = df.filter(condition)
    return df.selectExpr(*expressions)


def _fixture_sql(name: str) -> str:
    source, expressions, condition = FIXTURES[name]
    return f"SELECT {', '.join(expressions)} FROM {source}" + (f" WHERE {condition}" if condition else "")


CUSTOMER_REF = reference_sql("customer", "c_custkey")

# Further SQL inputs, in order of dependence.
VIEWS: dict[str, str] = {
    **{name: _fixture_sql(name) for name in FIXTURES},
    "keyed_customer": f"SELECT *, {CUSTOMER_REF} AS external_reference FROM src_customer",
    "xwalk": (f"SELECT '{SYSTEM}' AS source_system, 'customer' AS source_entity, {CUSTOMER_REF} AS external_reference, "
              f"'{TARGET}' AS target_system, 'account' AS target_table, CAST(1000 + c_custkey AS VARCHAR) AS target_id "
              "FROM customer WHERE c_custkey % 3 = 0"),
    "tgt_account": ("SELECT 1000 + c_custkey AS id, substr(c_name, 1, 12) AS name, c_mktsegment AS segment, "
                    "c_nationkey AS nation_id, CASE WHEN c_custkey % 9 = 0 THEN c_acctbal + 1 ELSE c_acctbal END "
                    "AS balance FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 15 <> 0"),
    "outbox": f"SELECT *, '{TARGET}' AS target_system, {reference_sql('user', 'user_id')} AS external_reference "
              "FROM outbox_base",
    "control": f"SELECT DISTINCT event_type AS source_entity, '{TARGET}' AS target_system, event_type <> 'error' "
               "AS enabled FROM events",
    "catalog_v2": "SELECT * FROM catalog_v2_kept UNION ALL SELECT * FROM catalog_v2_extra",
    "footprints": "SELECT * FROM foot_0 UNION SELECT * FROM foot_1 UNION SELECT * FROM foot_2",
}

_NEEDS = {
    "keyed_customer": ["src_customer"], "outbox": ["outbox_base"],
    "catalog_v2": ["catalog_v2_kept", "catalog_v2_extra"], "footprints": ["foot_0", "foot_1", "foot_2"],
}


def sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """A statement over the named inputs."""
    wanted: list[str] = []
    for name in views:
        wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    parts = [f"{n} AS ({VIEWS[n]})" for n in wanted] + [f"{n} AS ({s})" for n, s in (extra or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def keyed_customer(spark: SparkSession, folder: str) -> DataFrame:
    df = fixture(spark, folder, "src_customer")
    return df.withColumn("external_reference", reference_for(df, SYSTEM, SCHEMA, "customer", ["c_custkey"]))


def crosswalk(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "customer").filter("c_custkey % 3 = 0")
    return df.select(
        F.lit(SYSTEM).alias("source_system"), F.lit("customer").alias("source_entity"),
        reference_for(df, SYSTEM, SCHEMA, "customer", ["c_custkey"]).alias("external_reference"),
        F.lit(TARGET).alias("target_system"), F.lit("account").alias("target_table"),
        (F.col("c_custkey") + 1000).cast("string").alias("target_id"))


def tgt_account(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").filter("c_custkey % 3 = 0 AND c_custkey % 15 <> 0").selectExpr(
        "1000 + c_custkey AS id", "substr(c_name, 1, 12) AS name", "c_mktsegment AS segment",
        "c_nationkey AS nation_id", "CASE WHEN c_custkey % 9 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance")


def outbox(spark: SparkSession, folder: str) -> DataFrame:
    df = fixture(spark, folder, "outbox_base")
    return df.withColumn("target_system", F.lit(TARGET)).withColumn(
        "external_reference", reference_for(df, SYSTEM, SCHEMA, "user", ["user_id"]))


def control(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_type").alias("source_entity")).distinct().select(
        "source_entity", F.lit(TARGET).alias("target_system"), (F.col("source_entity") != "error").alias("enabled"))


def catalog(spark: SparkSession, folder: str, version: int) -> DataFrame:
    if version == 1:
        return fixture(spark, folder, "catalog_v1")
    return fixture(spark, folder, "catalog_v2_kept").unionByName(fixture(spark, folder, "catalog_v2_extra"))


def footprints(spark: SparkSession, folder: str) -> DataFrame:
    df = fixture(spark, folder, "foot_0")
    return df.unionByName(fixture(spark, folder, "foot_1")).unionByName(fixture(spark, folder, "foot_2")).distinct()


ACCOUNT = TableContract("account", (
    ColumnContract("id", "bigint", nullable=False, primary_key=True),
    ColumnContract("name", "varchar(12)", nullable=False),
    ColumnContract("segment", "varchar(20)", enum_values=("AUTO", "BLDG", "HOUSEHOLD", "MACHINERY")),
    ColumnContract("nation_id", "int"),
    ColumnContract("balance", "double"),
), (ForeignKey("nation_id", "nation", "n_nationkey"),))
ACCOUNT_DETAIL = TableContract("account_detail", (
    ColumnContract("id", "bigint", nullable=False, primary_key=True, generated=True),
    ColumnContract("account_id", "bigint", nullable=False),
    ColumnContract("balance", "double"),
    ColumnContract("opened", "timestamp"),
), (ForeignKey("account_id", "account"),))
NATION = TableContract("nation", (
    ColumnContract("n_nationkey", "int", nullable=False, primary_key=True),
    ColumnContract("n_name", "varchar(25)", nullable=False),
))
MODEL = TargetContract((ACCOUNT, ACCOUNT_DETAIL, NATION))
REMAP = 'enum_remap:{"AUTOMOBILE":"AUTO","BUILDING":"BLDG"}'
REMAP_SQL = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AUTO' WHEN 'BUILDING' THEN 'BLDG' ELSE c_mktsegment END"
# Fixture names hold blanks and tabs only; both ends are stripped of them.
STRIP_SQL = "trim(c_name, ' ' || chr(9))"
