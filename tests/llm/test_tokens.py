"""Encoding, decoding and counting against the libraries themselves."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer, pre_tokenizers

from rowferry.llm import byte_bpe, pretokens, token_counts
from rowferry.llm.queries import vocabulary

ALPHABET = [" ", "  ", "\n", "\t", "a", "the", "é", "ß", "'s", "'ll", "'S", "'t", "'ve", "'", "''", "1", "23", "!", "...", "。", "漢",
            " ", "\u0085", "​", "🙂", "é", "x", "aa", "   ", "--", "==", "<|endoftext|>", "՘"]


def strings(n, seed=3):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return made + ["a" * 5000, "=" * 9000, " " * 3000 + "x", "-" * 4097 + "aé" * 3000, "", "".join(rng.choices("abcdefghij", k=9000))]


@pytest.fixture(scope="module")
def ranks():
    return vocabulary("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference(ranks):
    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs, special_tokens={})


@pytest.fixture(scope="module")
def classes():
    return pretokens.class_table(pretokens.class_runs())


def test_pieces_are_those_of_the_library(classes):
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    texts = strings(3000)
    ours = pretokens.pieces(texts, classes)
    assert ["".join(p) for p in ours] == texts
    for text, found in zip(texts, ours, strict=True):
        assert [len(p) for p in found] == [b - a for _, (a, b) in split.pre_tokenize_str(text)]


def test_classes_of_every_character(classes):
    for pattern, kind in ((r"a", pretokens.LETTER), ("1", pretokens.DIGIT), ("!", pretokens.OTHER), (" ", pretokens.SPACE)):
        assert classes[ord(pattern)] == kind
    # Characters that are newer than the libraries' Unicode are no letters for them.
    assert classes[0x0558] == pretokens.OTHER


def test_encode_and_decode(docs_of, ranks, reference):
    texts = strings(400)
    df = docs_of([(i, t, None, None) for i, t in enumerate(texts)] + [(None, None, None, None)], clashing=True)
    encoded = byte_bpe.encode(df, ranks, offsets=True, decoded=True).withColumnRenamed("decoded", "at_once")
    rows = byte_bpe.decode(encoded, ranks).collect()
    assert len(rows) == len(texts) + 1 and all(r["at_once"] == r["decoded"] for r in rows)
    for row in rows:
        text = row["text"] or ""
        assert row["ids"] == reference.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()
        parts = [reference.decode_single_token_bytes(i) for i in row["ids"]]
        assert row["byte_starts"] == [sum(map(len, parts[:k])) for k in range(len(parts))]
        cover = [k for k, c in enumerate(text) for _ in c.encode()]
        assert row["char_starts"] == [cover[b] for b in row["byte_starts"]]


def test_split_characters(ranks, reference):
    text = "𐍈 漢字 🙂é"
    ids = reference.encode_ordinary(text)
    parts = byte_bpe.token_texts(ids, ranks)
    assert "".join(parts) == text and len(parts) == len(ids)
    assert byte_bpe.token_texts([], ranks) == []


def test_counts_are_those_of_the_library(docs_of, documents):
    content = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_str(content.decode())
    texts = strings(400) + [r[0] for r in documents.limit(100).select("text").collect()]
    df = docs_of([(i, t, None, None) for i, t in enumerate(texts)] + [(None, None, None, None)], clashing=True)
    for row in token_counts.count_tokens(df, content, keep=["doc_id", "text"]).collect():
        text = row["text"] or ""
        assert row["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids)
        assert row["n_bytes"] == len(text.encode())


def test_counts_with_a_small_table(classes):
    content = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_str(content.decode())
    machine = token_counts.Transducer(content, most=500)
    texts = strings(300, seed=5)
    for first in range(0, len(texts), 50):
        part = texts[first:first + 50]
        assert machine.count(part, classes).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in part]


def test_long_pieces_in_one_scan(classes):
    """Pieces over hundreds of chunks, alone and between others, with maps that meet soon and maps that hardly do."""
    content = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_str(content.decode())
    rng = random.Random(8)
    texts = ["a" * 200_000, "ab" * 50_001, "x " + "é" * 40_000, "".join(rng.choices("etaoin", k=60_000)) + " the end", "=" * 65_536, "漢" * 9000]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    machine = token_counts.Transducer(content)
    assert [int(machine.count([t], classes)[0]) for t in texts] == want
    assert machine.count(texts, classes).tolist() == want
    few = token_counts.Transducer(content, most=300)
    assert few.count([t[:5000] for t in texts], classes).tolist() == [
        len(library.encode(t[:5000], add_special_tokens=False).ids) for t in texts]


def test_reached_is_what_single_steps_reach():
    rng = np.random.default_rng(4)
    for _ in range(50):
        size = int(rng.integers(1, 40))
        follow = np.minimum(np.arange(size) + rng.integers(0, 4, size), size - 1)
        roots = rng.integers(0, size, 3)
        want = set()
        for at in roots.tolist():
            while at not in want:
                want.add(at)
                at = int(follow[at])
        assert set(np.flatnonzero(token_counts._reached(follow, roots, size)).tolist()) == want


def test_no_texts_to_count(docs_of, spark):
    content = vocabulary("byte_bpe_50k.json")
    empty = docs_of([(1, "x", None, None)]).limit(0)
    assert token_counts.count_tokens(empty, content).collect() == []
    rows = token_counts.count_tokens(docs_of([(1, "", None, None), (1, "", None, None), (2, None, None, None)]), content).collect()
    assert [(r["n_tokens"], r["n_bytes"]) for r in rows] == [(0, 0)] * 3


def test_chunk_maps_compose(classes):
    """A piece over many chunks: every chunk starts from the state the one before ends in."""
    content = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_str(content.decode())
    machine = token_counts.Transducer(content)
    text = "ab" * 3 * token_counts.CHUNK
    assert machine.count([text, "", "x " + text], classes).tolist() == [
        len(library.encode(t, add_special_tokens=False).ids) for t in (text, "", "x " + text)]
    table = token_counts.Transitions(3)
    for k in range(100):
        table.put(k * 7, k)
    assert table.find(np.arange(0, 700, 7)).tolist() == list(range(100)) and table.get(5) == -1
