"""Byte-level BPE over Arrow batches, and the way back.

Ranks of byte strings become a BPE model of the tokenizers library, whose alphabet has one printable
character for every byte. A text is cut into the pieces of the splitting pattern; pieces that a task
has not met lately go through the library, the others come from a bounded memory. Decoding turns the
characters of a token back into its bytes. A token may end inside a character, so text is only made
from the joined bytes, or, token by token, when the bytes of a character are complete.

Null texts count as empty and give no tokens. Repeated rows, ties and other columns do not matter; an
empty table gives an empty table. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

from .batches import Measure, with_text_columns
from .pretokens import class_runs, class_table, pieces

REMEMBERED = 150_000
"""Pieces whose ids a task keeps."""
LONGEST_REMEMBERED = 48

ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
OFFSETS = T.StructType([
    *ENCODED.fields,
    T.StructField("byte_starts", T.ArrayType(T.IntegerType(), False)),
    T.StructField("char_starts", T.ArrayType(T.IntegerType(), False)),
])
DECODED = T.StructType([T.StructField("decoded", T.BinaryType())])


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(ranks: bytes) -> list[bytes]:
    """Tokens in the order of their ids, from lines of a base64 token and its rank."""
    pairs = [line.split() for line in ranks.splitlines() if line.strip()]
    by_id = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(by_id) != list(range(len(by_id))):
        raise ValueError("the ranks of a vocabulary must be 0, 1, 2, ...")
    return [by_id[i] for i in range(len(by_id))]


def spelled_tokens(ranks: bytes) -> list[str]:
    """Tokens in the characters that stand for their bytes."""
    letters = byte_characters()
    return ["".join(letters[b] for b in token) for token in read_ranks(ranks)]


def build_model(ranks: bytes) -> Tokenizer:
    """The library's model: every split of a token into two earlier tokens is a merge of its rank."""
    tokens = read_ranks(ranks)
    ids = {t: i for i, t in enumerate(tokens)}
    spell = spelled_tokens(ranks)
    merges = []
    for i, token in enumerate(tokens):
        cuts = [(ids.get(token[:k], i), ids.get(token[k:], i)) for k in range(1, len(token))]
        merges += [(spell[a], spell[b]) for a, b in sorted(cuts) if a < i and b < i]
    model = Tokenizer(models.BPE(vocab={s: i for i, s in enumerate(spell)}, merges=merges, ignore_merges=True))
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return model


class _Memory(dict):
    """Ids of pieces, refilled through the library."""

    def __init__(self, ranks: bytes) -> None:
        self.model = build_model(ranks)
        self.numbers = list(range(self.model.get_vocab_size()))  # one object for every id

    def encode(self, texts: list[list[str]]) -> list[list[int]]:
        if len(self) > REMEMBERED:
            self.clear()
        unseen = list({p for text in texts for p in text if p not in self})
        found = self.model.encode_batch_fast(unseen, add_special_tokens=False)
        self.update((p, tuple(map(self.numbers.__getitem__, e.ids))) for p, e in zip(unseen, found, strict=True))
        ids = [list(chain.from_iterable(map(self.__getitem__, text))) for text in texts]
        for p in unseen:
            if len(p) > LONGEST_REMEMBERED:
                del self[p]
        return ids


@lru_cache(maxsize=1)
def _memory(ranks: bytes) -> _Memory:
    return _Memory(ranks)


def _lists(values: np.ndarray, lengths: list[int]) -> pa.Array:
    ends = np.cumsum([0, *lengths])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, ranks: bytes, text: str = "text", offsets: bool = False, decoded: bool = False,
           keep: list[str] | None = None) -> DataFrame:
    """Adds `ids`; with `offsets` where every token begins in bytes and in characters, with `decoded` the ids' bytes.

    A token that begins inside a character is given that character's position. Decoding right behind the encoder spares
    a second set of Python workers; `decode` does the same for ids that are at hand.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks, class_runs()))  # a vocabulary file: fixed size
    schema = T.StructType([*(OFFSETS if offsets else ENCODED).fields, *(DECODED.fields if decoded else [])])

    def measure() -> Measure:
        vocabulary, runs = shared.value
        memory, classes, table = _memory(vocabulary), class_table(runs), reverse_table(vocabulary)
        sizes = np.array([len(t) for t in table], np.int64)

        def apply(texts: list[str]) -> list[pa.Array]:
            encoded = memory.encode(pieces(texts, classes))
            lengths = [len(x) for x in encoded]
            columns = [_lists(np.fromiter(chain.from_iterable(encoded), np.int32, sum(lengths)), lengths)]
            if offsets:
                begins = [np.cumsum(sizes[x]) - sizes[x] if x else np.zeros(0, np.int64) for x in encoded]
                places = [_characters(t, b) for t, b in zip(texts, begins, strict=True)]
                columns += [_lists(np.concatenate([np.zeros(0, np.int64), *parts]), lengths) for parts in (begins, places)]
            if decoded:
                columns.append(pa.array([b"".join(map(table.__getitem__, x)) for x in encoded], pa.binary()))
            return columns

        return apply

    return with_text_columns(docs, text, schema, measure, keep)


def _characters(text: str, byte_starts: np.ndarray) -> np.ndarray:
    """Character positions of byte positions."""
    data = np.frombuffer(text.encode(), np.uint8)
    return np.cumsum((data & 0xC0) != 0x80)[byte_starts] - 1 if len(byte_starts) else byte_starts


def decode(encoded: DataFrame, ranks: bytes, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds `decoded`, the bytes of the ids; null ids count as none. Other columns stay."""
    kept = [c for c in (encoded.columns if keep is None else keep) if c != "decoded"]
    schema = T.StructType([*[encoded.schema[c] for c in kept], *DECODED.fields])
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = reverse_table(shared.value)
        for batch in batches:
            # Some hundred rows at a time: ids of long texts need many times the room of a list array.
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part.column(part.schema.get_field_index("_ids_of_batch"))
                texts = [b"".join(map(table.__getitem__, lists[row].values.to_numpy(zero_copy_only=False).tolist()))
                         if lists[row].is_valid else b"" for row in range(len(lists))]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(c)) for c in kept], pa.array(texts, pa.binary())],
                    names=[*kept, "decoded"])

    rows = encoded.select(*[encoded[c] for c in kept], encoded[ids].alias("_ids_of_batch"))
    return rows.mapInArrow(run, schema)


def digests(ids: str = "ids", decoded: str = "decoded") -> list[Column]:
    """Number of tokens, and SHA-256 of the decimal ids joined by commas and of the decoded bytes."""
    return [F.size(ids).cast("bigint").alias("n_tokens"),
            F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
            F.sha2(decoded, 256).alias("decoded_sha256")]


@lru_cache(maxsize=2)
def reverse_table(ranks: bytes) -> list[bytes]:
    """Bytes of every id, read back from the characters that spell it."""
    back = {c: b for b, c in enumerate(byte_characters())}
    return [bytes(back[c] for c in token) for token in spelled_tokens(ranks)]


def token_texts(ids: list[int], ranks: bytes) -> list[str]:
    """What each token adds to the text; a character split over tokens appears with its last byte."""
    table = reverse_table(ranks)
    reader = codecs.getincrementaldecoder("utf-8")(errors="replace")
    return [reader.decode(table[i], final=k == len(ids) - 1) for k, i in enumerate(ids)]
