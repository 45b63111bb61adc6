"""Catalog frames from Spark schemas, schema exports and discovery rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coercion import contract_type
from ..operators.union import union_all

CATALOG = ("table_name string, position int, column_name string, data_type string, nullable boolean,"
           " is_primary_key boolean")
EXPORT = "map<string,array<struct<name:string,type:string,nullable:boolean,primary_key:boolean>>>"

# Contract type of each Spark type.
SPARK_CONTRACT_TYPES: dict[type[T.DataType], str] = {
    T.StringType: "string", T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer",
    T.LongType: "integer", T.FloatType: "float", T.DoubleType: "float", T.DecimalType: "float",
    T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "datetime", T.TimestampNTZType: "datetime",
}

_BITS = 62  # columns that one whole number tells apart


def from_schemas(
    spark: SparkSession, schemas: Mapping[str, T.StructType], primary_keys: Mapping[str, str] | None = None
) -> DataFrame:
    """Catalog of frames or datasets; only their schemas are looked at."""
    keys = primary_keys or {}
    rows = [
        (table, i, f.name, SPARK_CONTRACT_TYPES.get(type(f.dataType), "string"), f.nullable, keys.get(table) == f.name)
        for table, schema in sorted(schemas.items()) for i, f in enumerate(schema.fields)
    ]
    return spark.createDataFrame(rows, CATALOG)


def inclusions(frames: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    """(table_name, column_name, ref_table, ref_column): columns all of whose values are among those of a key column.

    The values of all columns that may refer are merged by value, and a value keeps one bit per column that has it: a task
    holds a value and a few whole numbers, however often the value occurs. Values that the same columns have are then counted
    together, and a column is included in a key when it shares as many values with it as it has. Null values refer to nothing;
    a column without values is included in nothing. Whole numbers and texts are compared, by kind.
    """
    kinds = {T.StringType: "string", **{t: "bigint" for t in (T.ByteType, T.ShortType, T.IntegerType, T.LongType)}}
    names = [(table, f.name, kinds[type(f.dataType)]) for table, df in sorted(frames.items()) for f in df.schema.fields
             if type(f.dataType) in kinds]
    is_key = [i for i, (t, c, _) in enumerate(names) if keys.get(t) == c]
    merged = []
    for kind in sorted({k for _, _, k in names}):
        of_kind = [i for i, (_, _, k) in enumerate(names) if k == kind]
        merged.append(_held([(i, frames[names[i][0]].select(F.col(f"`{names[i][1]}`").cast(kind).alias("value"))) for i in of_kind]))
    counts = union_all(*merged).select("n", F.explode("held").alias("at"), F.filter("held", lambda i: i.isin(is_key)).alias("keys")) \
        .select("n", "at", F.explode(F.concat("keys", F.array(F.lit(-1)))).alias("of")).groupBy("at", "of").agg(F.sum("n").alias("n"))
    whole = counts.filter("of = -1").select("at", F.col("n").alias("all"))
    table_of, column_of = (F.array(*[F.lit(n[k]) for n in names]) for k in (0, 1))
    return counts.filter("of >= 0 and of <> at").join(whole, "at").filter("n = all").select(
        F.get(table_of, "at").alias("table_name"), F.get(column_of, "at").alias("column_name"),
        F.get(table_of, "of").alias("ref_table"), F.get(column_of, "of").alias("ref_column"))


def _held(columns: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    """(held, n): numbers of the columns that have a value, and how many different values just these have.

    `columns` are numbered frames of one column `value`, all of one type.
    """
    words = [f"w{k}" for k in range(-(-len(columns) // _BITS))]
    bit = lambda j: F.lit(1 << j % _BITS).cast("bigint")
    parts = [df.filter(F.col("value").isNotNull()).select(
        "value", *[(bit(j) if k == j // _BITS else F.lit(0).cast("bigint")).alias(w) for k, w in enumerate(words)])
        for j, (_, df) in enumerate(columns)]
    values = union_all(*parts).groupBy("value").agg(*[F.bit_or(w).alias(w) for w in words])
    held = [F.when(F.col(words[j // _BITS]).bitwiseAND(bit(j)) != 0, F.lit(i)) for j, (i, _) in enumerate(columns)]
    return values.groupBy(*words).agg(F.count("*").alias("n")).select(
        F.filter(F.array(*held), lambda i: i.isNotNull()).alias("held"), "n")


def foreign_keys(frames: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    """Inclusions whose columns have the same name past a table prefix: what can be known without declared keys."""
    stem = lambda c: F.regexp_replace(c, "^[a-z]{1,2}_", "")
    return inclusions(frames, keys).filter((stem("column_name") == stem("ref_column")) & (F.col("table_name") != F.col("ref_table")))


def from_export(exports: DataFrame, document: str, *keep: str) -> DataFrame:
    """Catalog rows of JSON exports ``{table: [{name, type, nullable, primary_key}]}``."""
    tables = exports.select(*keep, F.explode(F.from_json(document, EXPORT)).alias("table_name", "_columns"))
    return tables.select(*keep, "table_name", F.posexplode("_columns").alias("position", "c")).select(
        *keep, "table_name", "position", F.col("c.name").alias("column_name"),
        contract_type(F.coalesce("c.type", F.lit("string"))).alias("data_type"),
        F.coalesce("c.nullable", F.lit(True)).alias("nullable"),
        F.coalesce("c.primary_key", F.lit(False)).alias("is_primary_key"))


def from_discovery(rows: DataFrame) -> DataFrame:
    """Catalog of information-schema rows."""
    def flag(name: str, default: str, wanted: str) -> Column:
        return F.upper(F.coalesce(name, F.lit(default))) == wanted

    return rows.select(
        "table_name", F.col("ordinal_position").alias("position"), "column_name",
        contract_type(F.col("data_type")).alias("data_type"), flag("is_nullable", "YES", "YES").alias("nullable"),
        flag("column_key", "", "PRI").alias("is_primary_key"))
