"""Quality rules in a bitmask ledger.

Every text is measured once and every rule is evaluated once; the ledger keeps the measurements and one
bit per failed rule. A policy is a named set of rules, so a new version, or the question what a rule
alone removes, needs only the bits: texts are not read again.

Words are runs of characters other than blank and the controls 9 to 13. Null and empty texts have no words, so
they fail `few_words`. Repeated rows get the same bits, an empty table gives an empty ledger, and a column of the
input with the name of a ledger column is replaced. Texts are measured whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import Measure, with_text_columns
from .pretokens import code_points
from .shingles import WORD, WordNumbers, window_hashes

SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 8

MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")])


@dataclass(frozen=True)
class Rule:
    """A condition on the measurements under which a text fails; its bit never changes."""

    bit: int
    name: str
    fails: Column


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


def rules() -> tuple[Rule, ...]:
    words, lines = F.col("n_words"), F.col("n_lines")
    return (
        Rule(0, "few_words", words < 20),
        Rule(1, "repeated_windows", 100 * F.col("n_repeat_words") > 30 * words),
        Rule(2, "symbols", 10 * F.col("n_symbols") > words),
        Rule(3, "repeated_lines", 100 * F.col("n_dup_lines") > 30 * lines),
        Rule(4, "short_words", F.col("word_chars") < 2 * words),
        Rule(5, "long_words", F.col("word_chars") > 20 * words),
        Rule(6, "capitals", 2 * F.col("n_upper") > F.col("word_chars")),
    )


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (
    BASE,
    Policy("v1", (*BASE.rules, "symbols", "repeated_lines")),
    Policy("v2", (*BASE.rules, "symbols", "repeated_lines", "short_words", "long_words", "capitals")),
)}
CURRENT = "v2"


def _measure() -> Measure:
    numbers = WordNumbers()

    def apply(texts: list[str]) -> list[pa.Array]:
        columns = np.array([_text_measures(t, numbers) for t in texts], np.int64).reshape(-1, len(MEASURES))
        return [pa.array(c) for c in columns.T]

    return apply


def _text_measures(text: str, numbers: WordNumbers) -> tuple[int, ...]:
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    joined = "".join(words)
    return (len(words), len(joined), len(SYMBOL.findall(text)), len(lines) - len(set(lines)),
            _repeated_words(numbers.of(words)), len(lines), _capitals(joined))


def _capitals(letters: str) -> int:
    small = letters.lower()
    if len(small) != len(letters):  # a few capitals become two characters
        return sum(map(str.isupper, letters))
    return int((code_points(letters) != code_points(small)).sum())


def _repeated_words(words: np.ndarray) -> int:
    """Words inside windows that occur at least twice."""
    hashes = window_hashes(words, WINDOW)
    if len(hashes) < 2:
        return 0
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    repeated = np.zeros(len(words) + 1, np.int64)
    starts = order[np.r_[same, False] | np.r_[False, same]]
    repeated[starts] += 1
    repeated[starts + WINDOW] -= 1
    return int((np.cumsum(repeated) > 0).sum())


def ledger(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Rows with their measurements and `failed_bits`, one bit per failed rule."""
    measured = with_text_columns(docs, text, MEASURES, _measure, keep)
    bits = reduce(lambda a, r: a.bitwiseOR(F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint")),
                  rules(), F.lit(0).cast("bigint"))
    return measured.withColumn("failed_bits", bits)


def mask(policy: Policy) -> int:
    known = {r.name: r.bit for r in rules()}
    return sum(1 << known[name] for name in policy.rules)


def passes(policy: Policy, bits: str = "failed_bits") -> Column:
    """Whether a row of a ledger fails no rule of the policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(kept_ledger: DataFrame, policy: Policy, bits: str = "failed_bits") -> DataFrame:
    """For every rule of the policy: rows that fail it, that fail only it, and that the policy keeps without it.

    One pass: rows are counted by their bits first, and there are at most 2 ** rules combinations.
    """
    relevant = F.col(bits).bitwiseAND(F.lit(mask(policy)))
    counts = kept_ledger.groupBy(relevant.alias("_bits")).agg(F.count("*").alias("_n"))
    chosen = [r for r in rules() if r.name in policy.rules]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("_bit"))
                               for r in chosen])).alias("_rule")
    rows = counts.select("_bits", "_n", each).select("_bits", "_n", "_rule.*")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("_n"))), F.lit(0))
    return rows.groupBy("rule").agg(
        total(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).alias("failed"),
        total(F.col("_bits") == F.col("_bit")).alias("failed_alone"),
        total(F.col("_bits").bitwiseAND(F.bitwise_not(F.col("_bit"))) == 0).alias("kept_without"),
        total(F.col("_bits") == 0).alias("kept"),
    ).withColumn("policy", F.lit(policy.version))
