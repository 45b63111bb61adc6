"""Text columns in Arrow batches, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20
"""Text handed to an operator at once; a single longer text is handed over alone."""

Measure = Callable[[list[str]], Sequence[pa.Array]]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts hold at most `most` bytes together, or one row."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = [0 if s is None else s for s in pc.binary_length(texts).to_pylist()]
    first, total = 0, 0
    for row, size in enumerate(sizes):
        if row > first and total + size > most:
            yield batch.slice(first, row - first)
            first, total = row, 0
        total += size
    if first < len(sizes):
        yield batch.slice(first)


def with_text_columns(
    docs: DataFrame, text: str, added: T.StructType, measure: Callable[[], Measure],
    keep: Sequence[str] | None = None, most: int = SLICE_BYTES,
) -> DataFrame:
    """Rows with columns computed from a text column; null texts count as empty.

    `measure` is called once per task and gives a function from texts to one array for every added field.
    `keep` names the input columns that come back, all by default; one with the name of an added column
    is replaced.
    """
    names = [f.name for f in added.fields]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    carried = "_text_of_slice"
    schema = T.StructType([docs.schema[c] for c in kept] + list(added.fields))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = measure()
        for batch in batches:
            for part in slices(batch, carried, most):
                texts = [t or "" for t in part.column(part.schema.get_field_index(carried)).to_pylist()]
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *apply(texts)], names=[*kept, *names])

    rows = docs.select(*[docs[c] for c in kept], docs[text].alias(carried))
    return rows.mapInArrow(run, schema)
