"""Deterministic keys and checksums, written as plain column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import float_text, plain_text

# Fixed value: the UUIDv5 namespace every external reference is derived in.
NAMESPACE = "12345678-1234-5678-1234-567812345678"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122 version 5 UUID of a string column."""
    prefix = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(prefix, F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def external_reference(
    system: str, schema: str, entity: str | Column, keys: Sequence[tuple[Column, T.DataType]]
) -> Column:
    """Stable reference of a source row: UUIDv5 over system, schema, table and key values."""
    entity = F.lit(entity) if isinstance(entity, str) else entity
    values = [F.coalesce(plain_text(c, dtype), F.lit("None")) for c, dtype in keys]
    return uuid5(F.concat_ws("|", F.lit(system), F.lit(schema), entity, *values))


def reference_for(df: DataFrame, system: str, schema: str, entity: str, keys: Sequence[str]) -> Column:
    """`external_reference` with the key types taken from the frame."""
    return external_reference(system, schema, entity, [(F.col(k), df.schema[k].dataType) for k in keys])


def _escape_non_ascii(text: Column) -> Column:
    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        above = code - 0x10000
        pair = F.concat(
            unit(F.lit(0xD800) + F.shiftright(above, 10)), unit(F.lit(0xDC00) + above.bitwiseAND(0x3FF))
        )
        return F.when(code < 128, ch).when(code < 0x10000, unit(code)).otherwise(pair)

    escaped = F.array_join(F.transform(F.split(text, ""), escape), "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), escaped).otherwise(text)


def _json_string(text: Column) -> Column:
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def _json_value(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        text = c.cast("string")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = float_text(c.cast("double"))
    elif isinstance(dtype, T.StructType):
        text = _json_object([(f.name, c[f.name], f.dataType) for f in dtype.fields])
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda item: _json_value(item, dtype.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    else:
        text = _json_string(plain_text(c, dtype))
    return F.coalesce(text, F.lit("null"))


def _json_object(fields: Sequence[tuple[str, Column, T.DataType]]) -> Column:
    parts: list[Column] = []
    for name, c, dtype in sorted(fields, key=lambda f: f[0]):
        parts += [F.lit(("," if parts else "{") + json.dumps(name, ensure_ascii=False) + ":"), _json_value(c, dtype)]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def json_value(c: Column, dtype: T.DataType) -> Column:
    """Compact JSON text of one value; dates, decimals and the like become strings."""
    return _escape_non_ascii(_json_value(c, dtype))


def canonical_json(fields: Sequence[tuple[str, Column, T.DataType]]) -> Column:
    """Key-sorted JSON without blanks, nulls kept, characters beyond ASCII escaped."""
    text = _json_object(fields)
    plain = not any(_holds_text(dtype) for _, _, dtype in fields) and all(name.isascii() for name, _, _ in fields)
    return text if plain else _escape_non_ascii(text)


def _holds_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.StructType, T.ArrayType, T.MapType, T.VariantType))


def row_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Canonical JSON of the named columns (all by default)."""
    return canonical_json([(n, F.col(f"`{n}`"), df.schema[n].dataType) for n in columns or df.columns])


def checksum(document: Column) -> Column:
    """SHA-256 of a canonical JSON text, as lower-case hex."""
    return F.sha2(document, 256)
