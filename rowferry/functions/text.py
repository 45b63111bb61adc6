"""String helpers whose results equal the ones a Python process would give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters ``str.strip`` removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Removes every kind of white space at both ends (``trim`` alone removes blanks only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def match_key(c: Column) -> Column:
    """Key for case-insensitive value matching; null becomes the empty string."""
    return F.coalesce(F.lower(strip(c.cast("string"))), F.lit(""))


def name_key(c: Column) -> Column:
    """Key for comparing identifiers: lower case without underscores and blanks."""
    return F.translate(F.lower(c), "_ ", "")


def float_text(c: Column) -> Column:
    """A double in shortest plain notation (``12345678.9``, not ``1.23456789E7``)."""
    java = c.cast("string")
    plain = F.regexp_replace(java.try_cast("decimal(38,22)").cast("string"), r"(\.\d+?)0*$", "$1")
    size = F.abs(c)
    scientific = F.regexp_replace(F.lower(java), r"\.0e", "e")
    scientific = F.regexp_replace(scientific, r"e(\d)", "e+$1")
    scientific = F.regexp_replace(scientific, r"e([+-])(\d)$", "e$10$2")
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(size == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size >= 1e-3) & (size < 1e7) | (size == 0), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def plain_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a value as ``str`` prints it; null stays null."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float_text(c.cast("double"))
    text = c.cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.when(F.instr(text, ".") > 0, F.rpad(text, 26, "0")).otherwise(text)
    return text


def substrings(c: Column, longest: Column | None = None) -> Column:
    """All distinct non-empty substrings, as an array; only those up to a length when one is given.

    Turns a containment test into an equality join. Names are short (engines allow 64 characters or
    so); for other words pass the length of the longest name looked for.
    """
    size = F.length(c)
    starts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(
        starts,
        lambda at: F.transform(
            F.sequence(F.lit(1), size - at + 1 if longest is None else F.least(size - at + 1, longest)),
            lambda n: F.substring(c, at, n)),
    )
    return F.array_distinct(F.flatten(pieces))
