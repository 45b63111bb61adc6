"""The named transforms a column mapping may use.

Each transform maps a column to its new value and, where it can fail, to a failure text. A failing
row never raises: the failure text ends up in the error list of the row.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import plain_text, strip

_INTEGER_TEXT = r"^[+-]?[0-9]+(_[0-9]+)*$"


class Result(NamedTuple):
    value: Column
    failure: Column | None = None


Transform = Callable[[Column, T.DataType], Result]


def _keep(c: Column, dtype: T.DataType) -> Result:
    return Result(c)


def _trim(c: Column, dtype: T.DataType) -> Result:
    return Result(strip(c) if isinstance(dtype, T.StringType) else c)


def _date_to_datetime(c: Column, dtype: T.DataType) -> Result:
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Result(c.cast("date").cast("timestamp_ntz"))
    return Result(c)


def _text_to_integer(c: Column, dtype: T.DataType) -> Result:
    if not isinstance(dtype, T.StringType):
        return Result(c.try_cast("bigint"), F.when(c.isNotNull() & c.try_cast("bigint").isNull(),
                                                  F.lit("value has no integer form")))
    text = strip(c)
    value = F.when(text.rlike(_INTEGER_TEXT), F.translate(text, "_", "").try_cast("bigint"))
    failed = c.isNotNull() & (c != "") & value.isNull()
    reason = F.concat(F.lit("invalid literal for int() with base 10: '"), c, F.lit("'"))
    return Result(value, F.when(failed, reason))


def _integer_to_text(c: Column, dtype: T.DataType) -> Result:
    return Result(plain_text(c, dtype))


def _enum_remap(argument: str) -> Transform:
    try:
        table = json.loads(argument)
    except ValueError as error:
        reason = str(error)
        return lambda c, dtype: Result(F.lit(None).cast(dtype), F.lit(reason))

    def remap(c: Column, dtype: T.DataType) -> Result:
        if not isinstance(dtype, T.StringType) or not table:
            return Result(c)
        pairs = [F.lit(x) for k, v in table.items()
                 for x in (k, v if v is None or isinstance(v, str) else json.dumps(v))]
        lookup = F.create_map(*pairs).cast("map<string,string>")
        return Result(F.when(F.map_contains_key(lookup, F.coalesce(c, F.lit(""))) & c.isNotNull(), lookup[c])
                      .otherwise(c))

    return remap


REGISTRY: dict[str, Transform] = {
    "none": _keep,
    "trim": _trim,
    "cast:date->datetime": _date_to_datetime,
    "cast:str->int": _text_to_integer,
    "cast:int->str": _integer_to_text,
}


def register(name: str, transform: Callable[[Column], Column]) -> None:
    """Adds a user transform: any function from Column to Column, a pandas_udf included."""
    REGISTRY[name] = lambda c, dtype: Result(transform(c))


def resolve(name: str | None) -> Transform:
    """The transform of that name; an unknown name leaves values as they are."""
    name = name or "none"
    if name.startswith("enum_remap:"):
        return _enum_remap(name.split(":", 1)[1])
    return REGISTRY.get(name, _keep)


def apply(name: str | None, c: Column, dtype: T.DataType) -> Result:
    return resolve(name)(c, dtype)


def default_timestamp(c: Column, as_of: Column | None = None) -> Column:
    """Missing audit times become the given moment, or now."""
    return F.coalesce(c, as_of if as_of is not None else F.current_timestamp())


def cut_to_width(c: Column, width: int | None) -> Column:
    return c if width is None else F.left(c, F.lit(width))


def clamp_years(c: Column, last: int = 9999) -> Column:
    """Dates after the last year a target accepts become null."""
    return F.when(F.year(c) <= last, c)
