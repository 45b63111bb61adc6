"""Projection and scalar transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import ColumnContract, FieldMapping, TableContract
from ..functions import coercion, transforms
from ..functions.keys import checksum, reference_for, row_json
from ..functions.text import match_key, name_key
from ..operators import projection
from .fixtures import (
    MODEL, REMAP, REMAP_SQL, SCHEMA, STRIP_SQL, SYSTEM, as_of, fixture, sql, table, uuid5_sql,
)
from .registry import query


def _src(spark, folder):
    return fixture(spark, folder, "src_customer")


def _mapped(spark, folder, *mappings, keep=("c_custkey",), as_of_=None):
    return projection.project(_src(spark, folder), mappings, keep, as_of_)


@query("b1_mapped_projection", sql(
    f"SELECT c_custkey AS customer_no, {STRIP_SQL} AS name, c_nationkey AS area FROM src_customer", "src_customer"))
def mapped_projection(spark, folder):
    rows = _mapped(
        spark, folder,
        FieldMapping("c_custkey", "account", "customer_no"), FieldMapping("c_name", "account", "name", "trim"),
        FieldMapping("no_such_column", "account", "ghost"), FieldMapping("c_acctbal", None, None),
        FieldMapping("c_mktsegment", "account", "area"), FieldMapping("c_nationkey", "account", "area"), keep=())
    return rows.drop("errors")


_FAN_OUT = (
    FieldMapping("c_name", "account", "name", "trim"), FieldMapping("c_mktsegment", "account", "segment", REMAP),
    FieldMapping("c_acctbal", "account", "balance"), FieldMapping("c_acctbal", "account_detail", "balance"),
    FieldMapping("opened_on", "account_detail", "opened", "cast:date->datetime"),
)


@query("b2_fan_out", sql(
    f"SELECT c_custkey, 'account' AS target, substr({STRIP_SQL}, 1, 12) AS label, c_acctbal AS balance FROM src_customer "
    "UNION ALL SELECT c_custkey, 'account_detail', CAST(CAST(opened_on AS TIMESTAMP) AS VARCHAR), c_acctbal "
    "FROM src_customer", "src_customer"))
def fan_out(spark, folder):
    staged = projection.stage(_src(spark, folder), _FAN_OUT, MODEL, ["c_custkey"])
    first = projection.fan_out(staged, "account", ["c_custkey"]).select(
        "c_custkey", F.lit("account").alias("target"), F.col("name").alias("label"), "balance")
    second = projection.fan_out(staged, "account_detail", ["c_custkey"]).select(
        "c_custkey", F.lit("account_detail").alias("target"), F.col("opened").cast("string").alias("label"), "balance")
    return first.unionByName(second)


@query("b3_managed_columns", sql("SELECT c_custkey, c_acctbal AS balance FROM src_customer", "src_customer"))
def managed_columns(spark, folder):
    mappings = (FieldMapping("c_custkey", "account_detail", "id"), FieldMapping("c_custkey", "account_detail", "account_id"),
                FieldMapping("c_acctbal", "account_detail", "balance"))
    staged = projection.stage(_src(spark, folder), mappings, MODEL, ["c_custkey"])
    return projection.fan_out(staged, "account_detail", ["c_custkey"])


@query("b4_identity", sql("SELECT c_custkey, c_name AS a, c_acctbal AS b FROM src_customer", "src_customer"))
def identity(spark, folder):
    return _mapped(spark, folder, FieldMapping("c_name", "t", "a", "none"),
                   FieldMapping("c_acctbal", "t", "b", "not a transform")).drop("errors")


@query("b5_trim", sql(f"SELECT c_custkey, {STRIP_SQL} AS name FROM src_customer", "src_customer"))
def trim(spark, folder):
    return _mapped(spark, folder, FieldMapping("c_name", "t", "name", "trim")).drop("errors")


@query("b6_date_to_datetime", (
    "SELECT event_id, date_trunc('day', ts) AS opened FROM events"))
def date_to_datetime(spark, folder):
    rows = projection.project(table(spark, folder, "events"),
                              [FieldMapping("ts", "t", "opened", "cast:date->datetime")], ["event_id"])
    return rows.drop("errors")


@query("b7_text_to_integer", sql(
    "SELECT c_custkey, TRY_CAST(CASE WHEN regexp_full_match(trim(code_txt), '[+-]?[0-9]+') THEN trim(code_txt) END "
    "AS BIGINT) AS code, CASE WHEN code_txt IN ('12.5', 'abc') THEN 'transform failed for code_txt -> code: invalid "
    "literal for int() with base 10: ''' || code_txt || '''' ELSE '' END AS problem FROM src_customer", "src_customer"))
def text_to_integer(spark, folder):
    rows = _mapped(spark, folder, FieldMapping("code_txt", "t", "code", "cast:str->int"))
    return rows.withColumn("problem", F.array_join("errors", "; ")).drop("errors")


@query("b8_integer_to_text", sql(
    "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_acctbal AS VARCHAR) AS balance FROM src_customer",
    "src_customer"))
def integer_to_text(spark, folder):
    return _mapped(spark, folder, FieldMapping("c_nationkey", "t", "nation", "cast:int->str"),
                   FieldMapping("c_acctbal", "t", "balance", "cast:int->str")).drop("errors")


@query("b9_enum_remap", sql(
    f"SELECT c_custkey, {REMAP_SQL} AS segment, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END "
    "AS blanked FROM src_customer", "src_customer"))
def enum_remap(spark, folder):
    return _mapped(spark, folder, FieldMapping("c_mktsegment", "t", "segment", REMAP),
                   FieldMapping("c_mktsegment", "t", "blanked", 'enum_remap:{"MACHINERY":null}')).drop("errors")


@query("b10_default_timestamp", (
    "SELECT event_id, COALESCE(CASE WHEN event_id % 5 <> 0 THEN ts END, TIMESTAMP '2024-01-15 00:00:00') "
    "AS source_updated_at FROM events"))
def default_timestamp(spark, folder):
    rows = table(spark, folder, "events").withColumn("changed", F.when(F.col("event_id") % 5 != 0, F.col("ts")))
    return projection.project(rows, [FieldMapping("changed", "t", "source_updated_at")], ["event_id"],
                              as_of()).drop("errors")


@query("b11_width", sql(f"SELECT c_custkey, substr({STRIP_SQL}, 1, 12) AS name FROM src_customer", "src_customer"))
def width(spark, folder):
    staged = projection.stage(_src(spark, folder), _FAN_OUT[:1], MODEL, ["c_custkey"])
    return projection.fan_out(staged, "account", ["c_custkey"])


@query("b11_truncated_counts", sql(
    f"SELECT 'account.name' AS target_column, count(*) FILTER (WHERE length({STRIP_SQL}) > 12) AS truncated "
    f"FROM src_customer UNION ALL SELECT 'account.segment', count(*) FILTER (WHERE length({REMAP_SQL}) > 20) "
    "FROM src_customer", "src_customer"))
def truncated_counts(spark, folder):
    return projection.truncated_counts(_src(spark, folder), _FAN_OUT, MODEL)


@query("b12_coerce_integer", sql(
    "SELECT c_custkey, TRY_CAST(CASE WHEN regexp_full_match(trim(code_txt), '-*[0-9]+') THEN trim(code_txt) END AS BIGINT) "
    "AS code, c_acctbal = floor(c_acctbal) AS whole, CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(c_acctbal AS BIGINT) "
    "END AS balance, NOT regexp_full_match(trim(code_txt), '-*[0-9]+') AS uncoerced FROM src_customer", "src_customer"))
def coerce_integer(spark, folder):
    df = _src(spark, folder)
    code = coercion.coerce(F.col("code_txt"), df.schema["code_txt"].dataType, "integer")
    balance = coercion.coerce(F.col("c_acctbal"), df.schema["c_acctbal"].dataType, "integer")
    return df.select("c_custkey", code.value.alias("code"), (~balance.uncoerced).alias("whole"),
                     balance.value.alias("balance"), code.uncoerced.alias("uncoerced"))


@query("b13_coerce_float", sql(
    "SELECT c_custkey, TRY_CAST(trim(code_txt) AS DOUBLE) AS code, CAST(c_nationkey AS DOUBLE) AS nation, "
    "TRY_CAST(trim(code_txt) AS DOUBLE) IS NULL AS uncoerced FROM src_customer", "src_customer"))
def coerce_float(spark, folder):
    df = _src(spark, folder)
    code = coercion.coerce(F.col("code_txt"), df.schema["code_txt"].dataType, "float")
    nation = coercion.coerce(F.col("c_nationkey"), df.schema["c_nationkey"].dataType, "float")
    return df.select("c_custkey", code.value.alias("code"), nation.value.alias("nation"),
                     code.uncoerced.alias("uncoerced"))


_WORDS = ("CASE o_orderkey % 8 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'y' WHEN 2 THEN '0' WHEN 3 THEN '' WHEN 4 THEN 'No' "
          "WHEN 5 THEN 'maybe' WHEN 6 THEN 't' ELSE o_orderstatus END AS word")


@query("b14_coerce_boolean", sql(
    "SELECT o_orderkey, CASE WHEN lower(trim(word)) IN ('true', 't', '1', 'yes', 'y') THEN true WHEN lower(trim(word)) IN "
    "('false', 'f', '0', 'no', 'n', '') THEN false END AS flag, o_orderkey % 3 <> 0 AS nonzero, lower(trim(word)) NOT IN "
    "('true', 't', '1', 'yes', 'y', 'false', 'f', '0', 'no', 'n', '') AS uncoerced FROM w",
    extra={"w": f"SELECT o_orderkey, {_WORDS} FROM orders"}))
def coerce_boolean(spark, folder):
    df = table(spark, folder, "orders").selectExpr("o_orderkey", "o_orderkey % 3 AS third", _WORDS)
    word = coercion.coerce(F.col("word"), df.schema["word"].dataType, "boolean")
    third = coercion.coerce(F.col("third"), df.schema["third"].dataType, "boolean")
    return df.select("o_orderkey", word.value.alias("flag"), third.value.alias("nonzero"),
                     word.uncoerced.alias("uncoerced"))


@query("b15_coerce_string", (
    "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS a, CAST(o_totalprice AS VARCHAR) AS b, o_orderdate AS c, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS d FROM orders"))
def coerce_string(spark, folder):
    df = table(spark, folder, "orders").selectExpr("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                                                   "o_orderkey % 2 = 0 AS even")
    kinds = [("o_custkey", "string", "a"), ("o_totalprice", "string", "b"), ("o_orderdate", "datetime", "c"),
             ("even", "string", "d")]
    return df.select("o_orderkey", *[
        coercion.coerce(F.col(n), df.schema[n].dataType, g).value.alias(o) for n, g, o in kinds])


_TYPED = TableContract("typed", (
    ColumnContract("key", "bigint"), ColumnContract("code_txt", "int"), ColumnContract("c_nationkey", "varchar(10)"),
    ColumnContract("c_acctbal", "numeric(12,2)")))


@query("b16_coerce_rows", sql(
    "SELECT c_custkey, TRY_CAST(CASE WHEN regexp_full_match(trim(code_txt), '-*[0-9]+') THEN trim(code_txt) END AS BIGINT) "
    "AS code_txt, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal, CASE WHEN NOT regexp_full_match(trim(code_txt), "
    "'-*[0-9]+') THEN 'code_txt' ELSE '' END AS uncoerced FROM src_customer", "src_customer"))
def coerce_rows(spark, folder):
    rows = _src(spark, folder).select("c_custkey", "code_txt", "c_nationkey", "c_acctbal")
    return projection.coerce_rows(rows, _TYPED).withColumn("uncoerced", F.array_join("uncoerced", ","))


@query("b17_date_clamp", (
    "SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1998 THEN o_orderdate END AS o_orderdate FROM orders"))
def date_clamp(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", transforms.clamp_years(F.col("o_orderdate"), 1998).alias("o_orderdate"))


@query("b18_nested_to_json", (
    "SELECT o_orderkey, '{\"status\":\"' || o_orderstatus || '\",\"total\":' || CAST(o_totalprice AS VARCHAR) || '}' "
    "AS detail, '[' || CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS VARCHAR) || ']' AS keys FROM orders"))
def nested_to_json(spark, folder):
    nested = table(spark, folder, "orders").select(
        "o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")).alias("detail"),
        F.array("o_orderkey", "o_custkey").alias("keys"))
    return projection.serialise_nested(nested)


@query("b19_payload_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def payload_decode(spark, folder):
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k bigint").alias("p")) \
        .select("event_id", "p.k")


_PAYLOAD_SQL = (
    "'{\"c_acctbal\":' || CAST(c_acctbal AS VARCHAR) || ',\"c_custkey\":' || CAST(c_custkey AS VARCHAR) || ',\"c_name\":' || "
    "CASE WHEN c_name IS NULL THEN 'null' ELSE CAST(to_json(c_name) AS VARCHAR) END || ',\"opened_on\":\"' || "
    "CAST(opened_on AS VARCHAR) || '\"}'")


@query("b20_payload", sql(
    "SELECT c_custkey, '{\"c_custkey\":' || CAST(c_custkey AS VARCHAR) || ',\"external_reference\":\"' || external_reference "
    "|| '\"}' AS payload FROM keyed_customer", "keyed_customer"))
def payload(spark, folder):
    df = _src(spark, folder).select("c_custkey")
    df = df.withColumn("external_reference", reference_for(df, SYSTEM, SCHEMA, "customer", ["c_custkey"]))
    return df.select("c_custkey", row_json(df).alias("payload"))


@query("b21_checksum", sql(
    f"SELECT c_custkey, {_PAYLOAD_SQL} AS js, sha256({_PAYLOAD_SQL}) AS checksum FROM src_customer", "src_customer"))
def payload_checksum(spark, folder):
    df = _src(spark, folder)
    js = row_json(df, ["opened_on", "c_name", "c_custkey", "c_acctbal"])
    return df.select("c_custkey", js.alias("js"), checksum(js).alias("checksum"))


_LINE_NAME = f"'{SYSTEM}|{SCHEMA}|lineitem|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)"


@query("b22_external_reference", f"SELECT l_orderkey, l_linenumber, {uuid5_sql(_LINE_NAME)} AS ref FROM lineitem")
def line_reference(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.select("l_orderkey", "l_linenumber", reference_for(
        df, SYSTEM, SCHEMA, "lineitem", ["l_orderkey", "l_linenumber"]).alias("ref"))


_NATIVE = ("CASE p_partkey % 9 WHEN 0 THEN 'VARCHAR(' || CAST(p_size AS STRING) || ')' WHEN 1 THEN 'numeric(10,2)' "
           "WHEN 2 THEN 'tinyint' WHEN 3 THEN 'timestamp with time zone' WHEN 4 THEN 'bytea' WHEN 5 THEN 'uuid' "
           "WHEN 6 THEN 'bit' WHEN 7 THEN 'jsonb' ELSE p_type END AS native")


@query("b23_type_map", sql(
    "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'string' WHEN 1 THEN 'float' WHEN 2 THEN 'integer' WHEN 3 THEN "
    "'datetime' WHEN 4 THEN 'binary' WHEN 5 THEN 'uuid' WHEN 6 THEN 'boolean' WHEN 7 THEN 'json' ELSE 'string' END "
    "AS any_engine, CASE p_partkey % 9 WHEN 1 THEN 'float' WHEN 2 THEN 'integer' WHEN 6 THEN 'boolean' ELSE 'string' END "
    "AS mysql FROM part"))
def type_map(spark, folder):
    df = table(spark, folder, "part").selectExpr("p_partkey", _NATIVE)
    return df.select("p_partkey", coercion.generic_type(F.col("native")).alias("any_engine"),
                     coercion.generic_type(F.col("native"), "mariadb").alias("mysql"))


@query("b24_normalised_names", sql(
    f"SELECT c_custkey, lower(replace(replace('Acct_' || c_mktsegment || ' No', '_', ''), ' ', '')) AS name_key, "
    f"COALESCE(lower({STRIP_SQL}), '') AS match_key FROM src_customer", "src_customer"))
def normalised_names(spark, folder):
    name = F.concat(F.lit("Acct_"), "c_mktsegment", F.lit(" No"))
    return _src(spark, folder).select("c_custkey", name_key(name).alias("name_key"),
                                      match_key(F.col("c_name")).alias("match_key"))


@query("b27_redaction", (
    "SELECT event_id, '{\"kind\":\"' || event_type || '\",\"steps\":[{\"at\":' || CAST(user_id AS VARCHAR) || '}]}' AS tree "
    "FROM events"))
def redaction(spark, folder):
    nested = table(spark, folder, "events").select(
        "event_id", F.col("props").alias("payload"), F.struct(
            F.col("event_type").alias("kind"), F.col("value").alias("sample_values"),
            F.array(F.struct(F.col("user_id").alias("at"), F.col("props").alias("rows"))).alias("steps")).alias("tree"))
    hidden = ["payload", "sample_values", "rows"]
    return projection.redact(nested, hidden).select("event_id", F.to_json("tree").alias("tree"))


@query("k1_transform_registry", sql(
    f"SELECT c_custkey, upper({REMAP_SQL}) || '!' AS segment FROM src_customer", "src_customer"))
def transform_registry(spark, folder):
    transforms.register("shout", lambda c: F.concat(F.upper(c), F.lit("!")))
    rows = _mapped(spark, folder, FieldMapping("c_mktsegment", "t", "c_mktsegment", REMAP))
    return projection.project(rows.drop("errors"), [FieldMapping("c_mktsegment", "t", "segment", "shout")],
                              ["c_custkey"]).drop("errors")
