"""Column functions against plain Python."""

import datetime as dt
import hashlib
import json
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.contracts import FieldMapping
from rowferry.functions import coercion, text, transforms
from rowferry.functions.keys import NAMESPACE, canonical_json, checksum, external_reference, row_json
from rowferry.operators import projection


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_strip_equals_python(spark):
    samples = [" a ", "\t\nb ", "　c d\x1c", "", "  ", "é ", "none"]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    assert one(df, text.strip(F.col("v"))) == [s.strip() for s in samples]


def test_float_text_equals_python(spark):
    samples = [0.0, -0.0, 1.5, 900.1, 12345678.9, 1e7, 1e15, 1.5e16, 1e22, 1e-3, 1.25e-4, 0.0001, 1e-5, 1.5e-7, -2.5e20,
               123456789012345.67, 0.1 + 0.2, 1e100, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(s,) for s in samples], "v double")
    assert one(df, text.float_text(F.col("v"))) == [str(s) for s in samples]


def test_plain_text_equals_python(spark):
    day, moment = dt.date(2024, 2, 3), dt.datetime(2024, 2, 3, 4, 5, 6, 120000)
    df = spark.createDataFrame([(True, 5, day, moment, moment.replace(microsecond=0), Decimal("2.50"))],
                               "b boolean, i int, d date, t timestamp_ntz, w timestamp_ntz, x decimal(5,2)")
    row = df.select(*[text.plain_text(F.col(f.name), f.dataType) for f in df.schema.fields]).first()
    assert list(row) == ["True", "5", str(day), str(moment), str(moment.replace(microsecond=0)), "2.50"]


def test_substrings(spark):
    df = spark.createDataFrame([("abca",), ("",), (None,)], "v string")
    found = one(df, text.substrings(F.col("v")))
    assert set(found[0]) == {"a", "b", "c", "ab", "bc", "ca", "abc", "bca", "abca"}
    assert not found[1] and not found[2]


@pytest.mark.parametrize("keys", [[1], ["x"], [None], [1, "y", 2.5], ["ü|ß"]])
def test_reference_is_uuid5(spark, keys):
    types = {int: T.LongType(), str: T.StringType(), float: T.DoubleType(), type(None): T.StringType()}
    columns = [(F.lit(k).cast(types[type(k)]), types[type(k)]) for k in keys]
    got = spark.range(1).select(external_reference("S", "sch", "tab", columns)).first()[0]
    assert got == str(uuid.uuid5(uuid.UUID(NAMESPACE), f"S|sch|tab|{'|'.join(str(k) for k in keys)}"))


def test_canonical_json_and_checksum_equal_python(spark):
    rows = [
        {"b": 'quote " back \\ slash', "a": 1, "c": 2.5, "d": None, "e": dt.date(2020, 1, 2), "f": True, "Z": "é\U0001f600"},
        {"b": "line\nbreak\ttab", "a": -7, "c": 1e-7, "d": "x", "e": None, "f": False, "Z": ""},
    ]
    df = spark.createDataFrame(rows, "b string, a bigint, c double, d string, e date, f boolean, Z string")
    expected = [json.dumps(r, sort_keys=True, separators=(",", ":"), default=str) for r in rows]
    js = row_json(df)
    assert one(df, js) == expected
    assert one(df, checksum(js)) == [hashlib.sha256(e.encode()).hexdigest() for e in expected]


def test_canonical_json_of_nested_values(spark):
    df = spark.sql("SELECT named_struct('y', 1, 'x', array('p', 'q')) AS s")
    got = df.select(canonical_json([("s", F.col("s"), df.schema["s"].dataType)])).first()[0]
    assert got == '{"s":{"x":["p","q"],"y":1}}'


def apply(df, name, column="v"):
    result = transforms.apply(name, F.col(column), df.schema[column].dataType)
    failure = result.failure if result.failure is not None else F.lit(None)
    return [tuple(r) for r in df.select(result.value.alias("v"), failure.alias("f")).collect()]


def test_text_to_integer(spark):
    samples = [" 12 ", "+7", "-3", "1_000", "", None, "12.5", "abc", "  "]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = apply(df, "cast:str->int")
    for sample, (value, failure) in zip(samples, got, strict=True):
        try:
            expected = int(sample) if sample not in (None, "") else None
            assert (value, failure) == (expected, None)
        except ValueError as error:
            assert value is None
            assert failure == str(error)


def test_date_to_datetime_drops_the_time(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4), dt.date(2024, 1, 2), "2024")],
                               "t timestamp_ntz, d date, s string")
    assert apply(df, "cast:date->datetime", "t")[0][0] == dt.datetime(2024, 1, 2)
    assert apply(df, "cast:date->datetime", "d")[0][0] == dt.datetime(2024, 1, 2)
    assert apply(df, "cast:date->datetime", "s")[0][0] == "2024"


def test_enum_remap(spark):
    df = spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "v string")
    assert [v for v, _ in apply(df, 'enum_remap:{"A":"x","B":null}')] == ["x", None, "C", None]
    assert all(f for _, f in apply(df, "enum_remap:{bad"))


def test_unknown_transform_keeps_values(spark):
    df = spark.createDataFrame([(" a ",)], "v string")
    assert apply(df, "no such transform") == [(" a ", None)]
    assert apply(df, "trim") == [("a", None)]


def test_width_and_years(spark):
    df = spark.createDataFrame([("0123456789ABCDEF",), ("short",), (None,)], "v string")
    assert one(df, transforms.cut_to_width(F.col("v"), 10)) == ["0123456789", "short", None]
    assert one(df, transforms.cut_to_width(F.col("v"), None)) == ["0123456789ABCDEF", "short", None]
    late = spark.sql("SELECT make_date(12000, 1, 1) AS v UNION ALL SELECT DATE '2024-01-01'")
    assert sorted(one(late, transforms.clamp_years(F.col("v")).isNull())) == [False, True]


@pytest.mark.parametrize("generic, samples, expected", [
    ("integer", ["123", " -5 ", "12.5", "abc", None, "--5"], [123, -5, None, None, None, None]),
    ("float", ["12.5", " 3 ", "1e3", "abc", None], [12.5, 3.0, 1000.0, None, None]),
    ("boolean", ["true", "Y", "0", "", "maybe", None], [True, True, False, False, None, None]),
    ("string", ["a", None], ["a", None]),
    ("date", ["2024-01-01", None], ["2024-01-01", None]),
])
def test_coerce_text(spark, generic, samples, expected):
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    result = coercion.coerce(F.col("v"), T.StringType(), generic)
    rows = df.select(result.value.alias("v"), result.uncoerced.alias("u")).collect()
    assert [r.v for r in rows] == expected
    assert [r.u for r in rows] == [s is not None and e is None for s, e in zip(samples, expected, strict=True)]


def test_coerce_numbers(spark):
    df = spark.createDataFrame([(42, 2.0, 2.5, True)], "i int, w double, f double, b boolean")

    def value(name, generic):
        return df.select(coercion.coerce(F.col(name), df.schema[name].dataType, generic).value).first()[0]

    assert value("i", "boolean") is True
    assert value("w", "integer") == 2
    assert value("f", "integer") is None
    assert value("b", "integer") == 1
    assert value("i", "float") == 42.0
    assert value("b", "string") == "True"


def test_type_maps(spark):
    df = spark.createDataFrame([("varchar(255)",), ("NUMERIC(10,2)",), ("tinyint",), ("character varying",), ("uuid",), ("odd",)],
                               "n string")
    assert one(df, coercion.generic_type(F.col("n"))) == ["string", "float", "integer", "string", "uuid", "string"]
    assert one(df, coercion.generic_type(F.col("n"), "mysql")) == ["string", "float", "integer", "string", "string", "string"]
    assert one(df, coercion.contract_type(F.col("n"))) == ["string", "float", "string", "string", "uuid", "string"]
    with pytest.raises(ValueError, match="no type map"):
        coercion.generic_type(F.col("n"), "oracle")
    assert coercion.type_table(spark).filter("native_type = 'double precision'").count() == 1


def test_serialise_and_redact(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'rows', 2) AS s, array(named_struct('rows', 1, 'b', 'x')) AS l, "
                   "map('rows', 1, 'k', 2) AS m, 'p' AS payload")
    clean = projection.redact(df, ["rows", "payload"])
    assert clean.columns == ["s", "l", "m"]
    row = projection.serialise_nested(clean).first()
    assert list(row) == ['{"a":1}', '[{"b":"x"}]', '{"k":2}']


def test_register_transform(spark):
    transforms.register("double it", lambda c: c * 2)
    df = spark.createDataFrame([(4,)], "v int")
    assert projection.project(df, [FieldMapping("v", "t", "w", "double it")]).first().w == 8
