"""Hard negatives of anchors, found exactly through an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; a pair of entries is a cell. For an anchor, an entry
bounds the score of its half from above and below: the product with the entry, plus and minus the anchor's length times the
entry's radius, the largest distance of a half vector from it. A multi-sequence heap visits the cells of an anchor in
the order of their summed upper bounds. What is looked for are windows: the best `k` rows with a score between two
limits, with the anchor's label or with another one. Once a window holds `k` rows, cells bounded below the last of them
cannot change it; the visit ends where that holds for all windows of the anchor, so the result is exact.

It runs in two searches, of positives (one window without limits) and of negatives (one window per positive), each of two
joins of anchors with cells: first with the best cells, then with all others that the windows found so far do not rule out.
Cells are stored as blocks of a bounded number of rows, and anchors meet a block in groups of bounded size, so a
cell with a third of all rows, or one that all anchors visit, is spread over tasks. Nothing limits the
cells or rows that an anchor meets. The halves' codebooks are fitted on `SAMPLE` rows, at most; all rows are indexed, and the
radii are taken over all rows. What reaches the driver is the sample and the cell directory, at most `MOST_ENTRIES`
squared cells.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of rows with one id the one with
the smallest label, then vector, takes part. Vectors of another length than that of the smallest id take no part; a component
beyond 32 bits after scaling is an error. An anchor without other rows of its label, or a positive without rows in its
window, gives no rows. Other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..operators.union import union_all
from ..sources.workspace import materialise
from .vectors import is_complete, matrix, of_one_length, products, squared_distances, whole_numbers

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95
"""A negative's score, in hundredths of its positive's."""

SAMPLE = 4096
ROWS_PER_CELL, MOST_ENTRIES = 512, 256
BLOCK, GROUP = 512, 256
"""Rows of a cell, and anchors, that meet at once."""
FIRST_ROWS = 1024
"""Rows in the cells that an anchor visits before its windows rule others out."""
HELD = 100_000
"""Rows found that a task holds before it sends them on."""

FAR = 1 << 62
FOUND = "anchor bigint, window int, candidate bigint, score bigint"


@dataclass(frozen=True)
class Index:
    """The two codebooks with the radii of their entries, and the rows of every cell."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray
    blocks: DataFrame | None
    """`cell` and up to about `BLOCK` of its rows, in the order of their ids."""


def indexable(rows: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """`id`, `label` and `numbers` of the rows that take part, one per id."""
    whole = rows.filter(rows[key].isNotNull() & label.isNotNull() & is_complete(rows[vector])).select(
        rows[key].cast("bigint").alias("id"), label.cast("bigint").alias("label"), whole_numbers(rows[vector], scale).alias("numbers"))
    first = whole.orderBy("id", "label", "numbers").select(F.size("numbers")).first()
    alike = of_one_length(whole, "numbers", None if first is None else first[0])
    rank = F.row_number().over(W.partitionBy("id").orderBy("label", "numbers"))
    return alike.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def above_root(square: np.ndarray | int) -> np.ndarray:
    """A whole number that is not below the square root, and less than two above it."""
    return np.floor(np.sqrt(np.asarray(square, np.float64))).astype(np.int64) + 1


# Index

def fit(sample: np.ndarray, entries: int, rounds: int = 6) -> np.ndarray:
    """A codebook of whole numbers for one half, by Lloyd rounds over a sample that start from distinct rows."""
    if not sample.shape[1]:
        return np.zeros((1, 0), np.int64)
    distinct = np.unique(sample, axis=0)
    book = distinct[np.linspace(0, len(distinct) - 1, min(entries, len(distinct))).astype(int)]
    for _ in range(rounds):
        near = squared_distances(sample, book).argmin(axis=1)
        counts = np.bincount(near, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, near, sample)
        book = np.where(counts[:, None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[:, None]), book)
    return book


def build(rows: DataFrame) -> Index | None:
    """The index over all rows; None without rows. The number of entries follows the number of rows."""
    count = rows.count()
    if not count:
        return None
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("numbers").collect()
    sample = np.array([r[0] for r in chosen], np.int64)
    half, width = sample.shape[1] // 2, sample.shape[1]
    entries = max(1, min(MOST_ENTRIES, math.ceil(math.sqrt(count / ROWS_PER_CELL))))
    books = (fit(sample[:, :half], entries), fit(sample[:, half:], entries))
    across = len(books[1])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = matrix(batch.column(2), width)
            near, far = [], []
            for part, book in ((numbers[:, :half], books[0]), (numbers[:, half:], books[1])):
                distances = squared_distances(part, book)
                near.append(distances.argmin(axis=1))
                far.append(above_root(distances[np.arange(len(part)), near[-1]]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((near[0] * across + near[1]).astype(np.int32)), *map(pa.array, far)],
                names=["id", "label", "numbers", "cell", "far0", "far1"])

    placed = materialise(rows.select("id", "label", "numbers").mapInArrow(
        place, "id bigint, label bigint, numbers array<int>, cell int, far0 bigint, far1 bigint"))
    directory = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far0").alias("far0"), F.max("far1").alias("far1"))
    sizes = np.zeros((len(books[0]), across), np.int64)
    radii = (np.zeros(len(books[0]), np.int64), np.zeros(across, np.int64))
    found = directory.collect()  # one row per cell, MOST_ENTRIES squared at most
    for r in found:
        i, j = divmod(r["cell"], across)
        sizes[i, j] = r["n"]
        radii[0][i], radii[1][j] = max(radii[0][i], r["far0"]), max(radii[1][j], r["far1"])
    parts = F.broadcast(rows.sparkSession.createDataFrame(
        [(r["cell"], -(-r["n"] // BLOCK)) for r in found], "cell int, _parts bigint"))  # as few rows as the directory
    slot = F.pmod(F.xxhash64("id"), F.col("_parts"))
    blocks = placed.join(parts, "cell").groupBy("cell", slot.alias("slot")).agg(
        F.sort_array(F.collect_list(F.struct("id", "label", "numbers"))).alias("rows")).drop("slot")
    return Index(books, radii, sizes, materialise(blocks))


# Search

def cells_by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """All pairs by the sum of their values, largest first: (sum, index in the first, index in the second)."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, a[i], b[j]
        # Every pair enters once: the next in its row, and the next row when the first of this one leaves.
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


def half_bounds(index: Index, anchor: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Upper and lower bounds of the half scores of an anchor, by half and entry.

    All are whole numbers, so every task that is run again visits the cells in the same order.
    """
    half = index.books[0].shape[1]
    upper, lower = [], []
    for part, book, radius in zip((anchor[:half], anchor[half:]), index.books, index.radii):
        middle, reach = products(part[None, :], book)[0], above_root((part * part).sum()) * radius
        upper.append(middle + reach)
        lower.append(middle - reach)
    return upper, lower


def visits(anchors: DataFrame, index: Index, first: bool) -> DataFrame:
    """(anchor, cell) pairs: the best cells of every anchor, or all later ones that its windows need."""
    bounds, sizes = Index(index.books, index.radii, index.sizes, None), index.sizes
    width = sum(book.shape[1] for book in index.books)
    schema = T.StructType([*anchors.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                piece = batch.slice(begin, 64)
                numbers = matrix(piece.column(2), width)
                windows, popped = piece.column(3).to_pylist(), piece.column(4).to_pylist()
                rows, cells, pops = [], [], []
                for k in range(piece.num_rows):
                    limits = [(w["low"], w["high"]) for w in windows[k]]
                    if not limits:
                        continue
                    least = min(low for low, _ in limits)
                    upper, lower = half_bounds(bounds, numbers[k])
                    taken, covered, at = [], 0, 0
                    for at, (bound, i, j) in enumerate(cells_by_bound(*upper), 1):
                        if bound < least or (first and covered >= FIRST_ROWS):
                            at -= 1
                            break
                        if not sizes[i, j] or at <= popped[k]:
                            continue
                        under = lower[0][i] + lower[1][j]
                        if any(bound >= low and under <= high for low, high in limits):
                            taken.append(i * sizes.shape[1] + j)
                            covered += int(sizes[i, j])
                    rows += [k] * len(taken)
                    cells += taken
                    pops += [at] * len(taken)
                if rows:
                    out = piece.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns[:4], pa.array(pops, pa.int64()), pa.array(cells, pa.int32())], names=schema.names)

    return anchors.mapInArrow(run, schema)


class _Best:
    """The best rows of every window of a task; sends them on when there are many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0
        self.last = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.held += len(columns[0])

    def shrink(self) -> None:
        anchor, window, candidate, score, k = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((candidate, -score, window, anchor))
        same = np.ones(len(order), bool)
        same[1:] = (anchor[order][1:] != anchor[order][:-1]) | (window[order][1:] != window[order][:-1])
        starts = np.flatnonzero(same)
        rank = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
        kept = order[rank < k[order]]
        self.parts = [tuple(c[kept] for c in (anchor, window, candidate, score, k))]
        self.held = self.last = len(kept)

    def flush(self) -> pa.RecordBatch:
        self.shrink()
        anchor, window, candidate, score, _ = self.parts[0]
        self.parts, self.held, self.last = [], 0, 0
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(window.astype(np.int32)), pa.array(candidate), pa.array(score)],
            names=["anchor", "window", "candidate", "score"])


def _scored(pairs: DataFrame, width: int) -> DataFrame:
    """The best rows of every window over the pairs of anchor groups and blocks that a task has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best()
        for batch in batches:
            for row in range(batch.num_rows):
                anchors, block = (batch.column(c).slice(row, 1).flatten() for c in (0, 1))
                ids, labels, numbers = block.field("id").to_numpy(), block.field("label").to_numpy(), matrix(block.field("numbers"), width)
                own, own_label = anchors.field("anchor").to_numpy(), anchors.field("label").to_numpy()
                scores = products(matrix(anchors.field("numbers"), width), numbers)
                lists_of = anchors.field("windows")
                counts = np.diff(lists_of.offsets.to_numpy())
                windows = lists_of.flatten()
                column = lambda name: windows.field(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                of = np.repeat(np.arange(len(own)), counts)  # the anchor of every window
                if not len(of):
                    continue
                equal = own_label[:, None] == labels[None, :]
                other = own[:, None] != ids[None, :]
                mine = scores[of]
                fits = (mine >= column("low")[:, None]) & (mine <= column("high")[:, None]) & other[of] \
                    & (equal[of] == column("same")[:, None])
                best_of = column("k").astype(np.int64)
                most = int(best_of.max())
                if len(ids) > 4 * most:
                    # Only the k-th best score of a window and what reaches it goes on.
                    ranked = np.where(fits, mine, -FAR)
                    cut = np.partition(ranked, len(ids) - most, axis=1)[:, len(ids) - most]
                    fits &= mine >= cut[:, None]
                line, place = np.nonzero(fits)
                if len(line):
                    best.add(own[of[line]], column("window")[line].astype(np.int64), ids[place], mine[line, place].astype(np.int64), best_of[line])
                if best.held > 2 * best.last + HELD:
                    best.shrink()
                    if best.held > HELD:
                        yield best.flush()
        if best.parts:
            yield best.flush()

    return pairs.select("anchors", "rows").mapInArrow(run, FOUND)


def _meet(anchors: DataFrame, index: Index, first: bool, groups: int) -> DataFrame:
    """What the anchors find in the cells they visit now."""
    asked = visits(anchors, index, first)
    group = F.pmod(F.xxhash64("anchor", F.lit("group")), F.lit(groups)).alias("group")
    met = asked.groupBy("cell", group).agg(F.collect_list(F.struct("anchor", "label", "numbers", "windows")).alias("anchors"))
    # Two keys: the blocks of a cell that many groups visit can be dealt over tasks by adaptive execution.
    keyed = lambda df: df.withColumn("_again", F.xxhash64("cell"))
    pairs = keyed(met).join(keyed(index.blocks), ["_again", "cell"])
    return _scored(pairs, sum(book.shape[1] for book in index.books))


def _ranked(found: DataFrame, k: Column) -> DataFrame:
    """The first rows of every window, with their rank."""
    order = W.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "candidate")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(anchors: DataFrame, index: Index, k: int, groups: int) -> DataFrame:
    """(anchor, window, candidate, score, rank) of the best `k` rows of every window of every anchor."""
    start = visits(anchors, index, True).groupBy("anchor").agg(F.max("popped").alias("_popped"))
    begun = materialise(_ranked(_meet(anchors, index, True, groups), F.lit(k)))
    # A full window rules out cells bounded below its last row.
    full = begun.filter(F.col("rank") == k).groupBy("anchor").agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("_full"))
    narrowed = F.transform("windows", lambda w: w.withField("low", F.greatest(
        w["low"], F.coalesce(F.try_element_at("_full", w["window"]), w["low"]))))
    known = anchors.drop("popped").join(full, "anchor", "left").join(start, "anchor", "left")
    left = known.select("anchor", "label", "numbers", F.when(F.col("_full").isNull(), F.col("windows")).otherwise(narrowed).alias("windows"),
                        F.coalesce("_popped", F.lit(0)).cast("bigint").alias("popped"))
    rest = _meet(left, index, False, groups)
    return _ranked(union_all(begun.drop("rank"), rest), F.lit(k))


def mine(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, anchors: Column | None = None,
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST,
) -> DataFrame | None:
    """(`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`); None without rows.

    `anchors` is a condition on `id`. A negative's score lies between `lowest` and `highest` hundredths of its positive's.
    """
    usable = materialise(indexable(rows, key, vector, rows["label"] if label is None else label, scale))
    index = build(usable)
    if index is None:
        return None
    chosen = usable if anchors is None else usable.filter(anchors)
    groups = max(1, -(-chosen.count() // GROUP))

    def window(number: Column, low: Column, high: Column, k: int, same: bool) -> Column:
        return F.struct(number.cast("int").alias("window"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"),
                        F.lit(k).alias("k"), F.lit(same).alias("same"))

    open_window = F.array(window(F.lit(0), F.lit(-FAR), F.lit(FAR), positives, True))
    asked = chosen.select(F.col("id").alias("anchor"), "label", "numbers", open_window.alias("windows"), F.lit(0).cast("bigint").alias("popped"))
    found = materialise(search(asked, index, positives, groups).select(
        "anchor", F.col("rank").alias("window"), F.col("candidate").alias("positive_id"), F.col("score").alias("positive_score")))
    # 100 * s >= lowest * p and 100 * s <= highest * p, in whole numbers; where the score is below zero none fits.
    low, high = F.ceil(F.col("positive_score") * lowest / F.lit(100).cast("decimal(3,0)")), F.floor(
        F.col("positive_score") * highest / F.lit(100).cast("decimal(3,0)"))
    limits = found.filter(low <= high).groupBy("anchor").agg(F.sort_array(F.collect_list(
        window(F.col("window"), low, high, negatives, False))).alias("windows"))
    again = usable.join(limits, usable["id"] == limits["anchor"]).select(
        "anchor", "label", "numbers", "windows", F.lit(0).cast("bigint").alias("popped"))
    hits = search(again, index, negatives, groups)
    return hits.join(found, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("candidate").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
