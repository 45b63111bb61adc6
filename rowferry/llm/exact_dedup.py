"""Exact duplicates by recipes of content-defined chunks.

A text is cut where its content says so: at the first sentence or line end after a minimal length. Long
texts are then only lists of chunk fingerprints, their recipes. Every chunk crosses the network once per task that
meets it, to prove that equal fingerprints mean equal chunks; should two chunks ever share one, they get
different numbers. Equal texts are rows with equal ordered lists of verified identifiers.

Null texts count as empty, and empty texts are equal to each other. Of rows with equal texts the one with the
largest id stays; a null id is smaller than any other, and of rows with the same id one stays. Other columns
do not matter, and an empty table gives an empty result. Only built-in column functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.workspace import materialise

Fingerprint = Callable[[Column], Column]
SMALLEST, LARGEST = 1024, 8192
"""Bounds of a chunk in characters."""


def chunks(text: Column, smallest: int = SMALLEST, largest: int = LARGEST) -> Column:
    """Consecutive parts of a text, ending at a sentence or line end where one is in reach."""
    pattern = rf"(?s).{{{smallest},{largest}}}?(?:[.!?]\s|\n)|.{{1,{largest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pair_of_hashes(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit("second"), chunk).alias("b"))


def _pieces(texts: DataFrame, fingerprint: Fingerprint) -> DataFrame:
    return texts.select("*", F.posexplode(chunks(F.col("_text"))).alias("_at", "chunk")) \
        .withColumn("print", fingerprint(F.col("chunk")))


def shared_fingerprints(texts: DataFrame, fingerprint: Fingerprint = pair_of_hashes) -> DataFrame:
    """Fingerprints that belong to more than one chunk: none, unless hashes collide."""
    contents = _pieces(texts.select("_text"), fingerprint).select("print", "chunk").distinct()
    return contents.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")


def recipes(docs: DataFrame, key: str, text: str, fingerprint: Fingerprint = pair_of_hashes) -> DataFrame:
    """Ids with the ordered verified chunk identifiers and the SHA-256 of their texts."""
    texts = docs.select(docs[key].alias("_id"), F.coalesce(docs[text], F.lit("")).alias("_text"))
    shared = materialise(shared_fingerprints(texts, fingerprint))
    digest = F.sha2(F.col("_text"), 256).alias("text_sha256")
    if shared.isEmpty():
        return texts.select("_id", digest, F.transform(chunks(F.col("_text")), lambda c: F.struct(
            fingerprint(c).alias("print"), F.lit(0).alias("number"))).alias("recipe"))
    rows = materialise(texts.withColumn("_row", F.monotonically_increasing_id()))
    pieces = _pieces(rows.select("_row", "_text"), fingerprint)
    numbers = pieces.join(shared, "print", "left_semi").select("print", "chunk").distinct().withColumn(
        "number", F.row_number().over(W.partitionBy("print").orderBy("chunk")))
    part = F.struct("print", F.coalesce("number", F.lit(0)).alias("number"))
    lists = pieces.join(numbers, ["print", "chunk"], "left").groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("_at", part.alias("part")))).alias("_parts"))
    return rows.join(lists, "_row", "left").select(
        "_id", digest, F.coalesce(F.transform("_parts", lambda p: p["part"]), F.array()).alias("recipe"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's id with `keep_id`, `group_size`, `kept` and `text_sha256`."""
    written = materialise(recipes(docs, key, text).withColumn("_row", F.monotonically_increasing_id()))
    # Counted per task before the shuffle. The join has one more key than the counts, so both sides are dealt anew and
    # adaptive execution can split a recipe that a third of all rows share: the other side has one row for it.
    groups = written.groupBy("recipe").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count("*").alias("group_size")) \
        .withColumn("_short", F.xxhash64("recipe"))
    return written.withColumn("_short", F.xxhash64("recipe")).join(groups, ["_short", "recipe"]).select(
        F.col("_id").alias(key), F.col("_keep._id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("_keep._row")).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with one row for every text, all columns as they were."""
    name = lambda digest: F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("-")), digest)
    kept = exact_duplicates(docs, key, text).filter("kept").select(name(F.col("text_sha256")).alias("_name"))
    rows = docs.withColumn("_name", name(F.sha2(F.coalesce(docs[text], F.lit("")), 256)))
    # Rows of one id and text have one name: the join brings them together, so one of them stays without a new shuffle.
    return rows.join(kept, "_name", "left_semi").dropDuplicates(["_name"]).drop("_name")
