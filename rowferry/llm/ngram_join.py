"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are compared as sets of five-word shingles. Texts with equal sets form a class at once, and only one of
them goes on. MinHash values in bands bring similar texts together. Candidates are then compared value by
value: after each step the posterior of the similarity (uniform prior) is looked at, and a pair is dropped when its chance
of reaching the threshold falls below a tolerance. What is left is verified on the shingle sets themselves.

A bucket of few texts gives its pairs. A larger one, such as that of a much edited template, is cut into blocks;
pairs of blocks are compared inside one task each, which returns link counts and a spanning forest, so that no table of
all its pairs is made. A pair belongs to the first band it meets in, so it is counted once.

Ids are unique but for repeated rows, which count as copies. Null texts count as empty. Texts without words are
similar to nothing, not even to each other, and rows without an id have neither class nor links. A text of less than five
words is one shingle. Other columns do not matter, and an empty table gives an empty result. Two shingles are
equal when their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.union import union_all
from ..sources.workspace import materialise
from .batches import Measure, with_text_columns
from .components import components
from .shingles import WORD, WordNumbers, scramble, shingle_set

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
VALUES = BANDS * ROWS
TOLERANCE = 1e-5
"""A candidate is dropped when its chance of reaching the threshold is below this."""
PAIRED = 12
"""Texts in a bucket up to which its pairs are listed."""
BLOCK = 192
"""Texts of a block of a larger bucket."""

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64)

SIGNED = T.StructType([T.StructField("set_key", T.BinaryType()), T.StructField("values", T.BinaryType())])
_BUCKETS = T.StructType([T.StructField("node", T.LongType()), T.StructField("band", T.IntegerType()),
                         T.StructField("bucket", T.LongType())])
_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_LINK = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType()),
                      T.StructField("links", T.LongType())])


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over a set of shingles."""
    least = np.full(VALUES, 0xFFFFFFFF, np.uint64)
    for first in range(0, len(shingles), 1024):
        block = shingles[first:first + 1024, None] * _FACTORS + _SHIFTS
        least = np.minimum(least, (block >> np.uint64(32)).min(0))
    return least.astype(np.uint32)


def band_hashes(values: np.ndarray) -> np.ndarray:
    """One hash per row and band of MinHash values."""
    parts = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for k in range(ROWS):
        total = scramble(total ^ parts[:, :, k])
    return total.view(np.int64)


@lru_cache(maxsize=None)
def least_matches(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values among those compared with which a pair stays.

    With a uniform prior the similarity has a Beta posterior, whose tail above the threshold is a binomial one.
    """
    n = compared + 1
    tail = 0.0
    for matches in range(n):
        tail += comb(n, matches) * threshold ** matches * (1 - threshold) ** (n - matches)
        if tail >= tolerance:
            return matches
    return n


def surviving(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Marks pairs of rows that stay after comparing value by value, a band's worth of values at a time."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for first in range(0, VALUES, BANDS):
        step = slice(first, first + BANDS)
        matches[alive] += (left[alive, step] == right[alive, step]).sum(1)
        alive = alive[matches[alive] >= least_matches(first + BANDS)]
    kept = np.zeros(len(left), bool)
    kept[alive] = True
    return kept


def first_bands(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first band in which each pair of rows agrees, BANDS where there is none."""
    equal = (left == right).reshape(len(left), BANDS, ROWS).all(2)
    return np.where(equal.any(1), equal.argmax(1), BANDS)


def jaccard(left: np.ndarray, right: np.ndarray) -> float:
    common = len(np.intersect1d(left, right, assume_unique=True))
    return common / (len(left) + len(right) - common) if common else 0.0


def _enough(left: np.ndarray, right: np.ndarray) -> bool:
    short, long = sorted((len(left), len(right)))
    return short >= THRESHOLD * long and jaccard(left, right) >= THRESHOLD


def _sign() -> Measure:
    numbers = WordNumbers()

    def apply(texts: list[str]) -> list[pa.Array]:
        keys, values = [], []
        for text in texts:
            shingles = shingle_set(numbers.of(WORD.findall(text)), WORDS)
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            values.append(minhash(shingles).tobytes() if len(shingles) else None)
        return [pa.array(keys, pa.binary()), pa.array(values, pa.binary())]

    return apply


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids with a digest of their shingle set and its MinHash values; nulls for texts without words."""
    return with_text_columns(docs.select(docs[key].alias("_id"), docs[text].alias("_text")), "_text", SIGNED, _sign, ["_id"])


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES)


def _bucket_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            hashes = band_hashes(_rows_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(nodes, BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(nodes))),
                pa.array(hashes.reshape(-1))], schema=_arrow(_BUCKETS))


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema.fields])


def _prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs that survive and that no large bucket compares."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, left, right, large = (batch.column(k) for k in range(5))
        left, right = _rows_of(left), _rows_of(right)
        in_large = large.to_numpy(zero_copy_only=False) >> first_bands(left, right) & 1
        kept = pa.array(surviving(left, right) & (in_large == 0))
        yield pa.RecordBatch.from_arrays([a.filter(kept), b.filter(kept)], schema=_arrow(_PAIR))


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = WordNumbers()
    for batch in batches:
        sets: dict[int, np.ndarray] = {}
        found = []
        for a, b, text_a, text_b, size_a, size_b in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if len(sets) > 200:
                sets.clear()
            for node, text in ((a, text_a), (b, text_b)):
                if node not in sets:
                    sets[node] = shingle_set(numbers.of(WORD.findall(text)), WORDS)
            if _enough(sets[a], sets[b]):
                found += [(a, min(a, b), size_b), (b, min(a, b), size_a)]
        yield _link_batch(found)


def _link_batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_arrow(_LINK))


def _compare_blocks(group: pa.Table) -> pa.Table:
    """Links between two blocks of a bucket, or inside one: every text's count, and a forest that joins them."""
    numbers = WordNumbers()
    nodes = group["node"].to_numpy()
    band, sizes = group["band"][0].as_py(), group["size"].to_numpy()
    values = _rows_of(group["values"].combine_chunks())
    block = group["block"].to_numpy()
    first, second = np.flatnonzero(block == group["i"][0].as_py()), np.flatnonzero(block == group["j"][0].as_py())
    texts = group["_text"].to_pylist()
    sets = [shingle_set(numbers.of(WORD.findall(t)), WORDS) for t in texts]
    lengths = np.array([len(s) for s in sets])
    inside = len(first) == len(second) and (first == second).all()
    links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for row in first.tolist():
        others = second[second > row] if inside else second
        short, long = np.minimum(lengths[others], lengths[row]), np.maximum(lengths[others], lengths[row])
        others = others[short >= THRESHOLD * long]
        if not len(others):
            continue
        left = np.broadcast_to(values[row], (len(others), VALUES))
        right = values[others]
        others = others[(first_bands(left, right) == band) & surviving(left, right)]
        hits = [o for o in others.tolist() if _enough(sets[row], sets[o])]
        if hits:
            links[row] += sizes[hits].sum()
            links[hits] += sizes[row]
            for o in hits:
                _unite(root, row, o)
    linked = np.flatnonzero(links)
    tops = np.array([_find(root, r) for r in linked.tolist()], np.int64)
    return pa.table([pa.array(nodes[linked]), pa.array(nodes[tops] if len(tops) else tops), pa.array(links[linked])],
                    schema=_arrow(_LINK))


def _find(root: np.ndarray, at: int) -> int:
    while root[at] != at:
        root[at] = root[root[at]]
        at = int(root[at])
    return at


def _unite(root: np.ndarray, a: int, b: int) -> None:
    a, b = _find(root, a), _find(root, b)
    if a != b:
        root[max(a, b)] = min(a, b)


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's id with `class_id`, the smallest id among the texts it is linked to, and `n_links`.

    Links are rows, copies included, with a similarity of at least the threshold; classes are their connected components.
    """
    signed = materialise(signatures(docs, key, text))
    nodes = materialise(signed.filter("_id is not null and set_key is not null").groupBy("set_key").agg(
        F.min("_id").alias("rep"), F.count("*").alias("size"), F.first("values").alias("values"))
        .withColumn("node", F.monotonically_increasing_id()))
    links = materialise(_links(docs.select(docs[key].alias("_id"), docs[text].alias("_text")), nodes))
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("links").alias("_links"))
    placed = nodes.select("node", "set_key", "rep", "size").join(roots.withColumnRenamed("u", "node"), "node", "left") \
        .join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = placed.join(named, "root").select(
        "set_key", "class_id", (F.col("size") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"))
    rows = signed.select("_id", F.when(F.col("_id").isNotNull(), F.col("set_key")).alias("set_key")) \
        .join(classes, "set_key", "left")
    return rows.select(F.col("_id").alias(key), F.coalesce("class_id", "_id").alias("class_id"),
                       F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _links(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(`node`, `root`, `links`): what a node is connected to and how many rows are linked to it, in parts."""
    every = nodes.select("node", "values").mapInArrow(_bucket_rows, _BUCKETS)
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialise(every.join(shared, "bucket"))
    is_large = F.col("n") > PAIRED
    large = members.filter(is_large).groupBy("node").agg(
        F.bit_or(F.expr("shiftleft(1L, band)")).alias("large_bands"))
    few = members.filter(~is_large).select("bucket", "node")
    pairs = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "bucket") \
        .filter("a < b").select("a", "b").distinct()
    known = nodes.select("node", "values").join(large, "node", "left").select(
        "node", "values", F.coalesce("large_bands", F.lit(0)).alias("large_bands"))
    left = known.select(F.col("node").alias("a"), F.col("values").alias("va"), F.col("large_bands").alias("la"))
    right = known.select(F.col("node").alias("b"), F.col("values").alias("vb"))
    candidates = materialise(pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb", "la")
                             .mapInArrow(_prune, _PAIR))
    wanted = union_all(candidates.select(F.col("a").alias("node")), candidates.select(F.col("b").alias("node")),
                       large.select("node")).distinct()
    held = nodes.join(wanted, "node", "left_semi").select("node", "rep", "size", "values")
    # Repeated rows of an id have one text: one of them is enough, and the join has brought them together.
    content = materialise(texts.join(held, texts["_id"] == held["rep"]).groupBy("rep", "node").agg(
        *[F.first(c).alias(c) for c in ("_text", "size", "values")]).drop("rep"))
    one = content.select(F.col("node").alias("a"), F.col("_text").alias("ta"), F.col("size").alias("sa"))
    two = content.select(F.col("node").alias("b"), F.col("_text").alias("tb"), F.col("size").alias("sb"))
    verified = candidates.join(one, "a").join(two, "b").select("a", "b", "ta", "tb", "sa", "sb").mapInArrow(_verify, _LINK)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int")
    crowded = members.filter(is_large).withColumn("blocks", blocks).withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    crowded = crowded.select("bucket", "band", "node", "block", F.least("block", "other").alias("i"),
                             F.greatest("block", "other").alias("j")).join(content, "node")
    compared = crowded.groupBy("bucket", "i", "j").applyInArrow(_compare_blocks, _LINK)
    return union_all(verified, compared)
