"""Token counts by a compiled finite-state tokenizer.

A BPE model is compiled, as far as the texts need it, into a deterministic transducer over bytes. Its
transitions carry the change of the token count, so that after any prefix of a piece the sum is the number
of tokens the model gives that prefix. A state holds what later bytes can still ask about: the
longest suffix that some token begins with and, for every border inside it at which a token can still
begin, which token ends there and how the count there differs. The last token of a prefix is the one suffix token that the
model leaves apart from the token before it; that check on two tokens is the library's own merge result.

The bytes of a batch are cut into chunks of equal length that step through the transducer together. A
chunk in which a piece begins maps every state to the same last state. Any other chunk is a map from
states to states with the count changes on the way, known where states are likely to occur. These maps are composed in a
prefix scan by doubling, which gives the state that every chunk begins in; with it all bytes before a
first border are counted at once. Counts are exact, however long a piece is.

Null texts count as empty and have no tokens; repeated rows and other columns do not matter, and an empty
table gives an empty one. Special strings inside a text are one token each, as the library takes them.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .batches import Measure, with_text_columns
from .byte_bpe import byte_characters
from .pretokens import byte_lengths, class_runs, class_table, code_points, piece_starts

CHUNK = 1024
MOST_STATES = 400_000
"""States kept at once (some 400 bytes each with what they need); then only those in use are kept."""

GUESSES = 4
"""Rounds in which all chunk maps are extended; then only those that the scan stops at, so work stays linear."""

_START, _DEAD = 0, 1
_ZERO = 128  # count changes are stored above this
_NONE = -1

COUNTED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())])


def _reached(follow: np.ndarray, roots: np.ndarray, steps: int) -> np.ndarray:
    """Marks what `follow` leads to from the roots: maps over 1, 2, 4 and more steps, each composed of the one before."""
    marked = np.zeros(len(follow), bool)
    marked[roots] = True
    for _ in range(steps.bit_length()):
        marked[follow[marked]] = True
        follow = follow[follow]
    return marked


class Transitions:
    """Hash table from a state and a byte to the next state and the count change, looked up by whole arrays."""

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, bits: int = 14) -> None:
        self.bits, self.size = bits, 0
        self.keys = np.full(1 << bits, _NONE, np.int64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self._MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, -1 where there is none."""
        slots = self._slots(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.values[slots], _NONE)
        rest = np.flatnonzero((held != keys) & (held != _NONE))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slots[rest]]
            hit = held == keys[rest]
            found[rest[hit]] = self.values[slots[rest[hit]]]
            rest = rest[~hit & (held != _NONE)]
        return found

    def get(self, key: int) -> int:
        slot = (key * int(self._MIX) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (held := int(self.keys[slot])) != key and held != _NONE:
            slot = slot + 1 & (1 << self.bits) - 1
        return int(self.values[slot]) if held == key else _NONE

    def put(self, key: int, value: int) -> None:
        if 2 * self.size >= 1 << self.bits:
            full = self.keys != _NONE
            keys, values = self.keys[full].tolist(), self.values[full].tolist()
            self.__init__(self.bits + 1)
            for k, v in zip(keys, values, strict=True):
                self.put(k, v)
        slot = (key * int(self._MIX) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[slot] != _NONE:
            slot = slot + 1 & (1 << self.bits) - 1
        self.keys[slot], self.values[slot] = key, value
        self.size += 1


class Transducer:
    """Count changes over bytes, compiled on demand; a transition is `next state << 8 | change + 128`."""

    def __init__(self, vocabulary: bytes, most: int = MOST_STATES) -> None:
        spec = json.loads(vocabulary)
        before = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or before != {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only byte-level BPE without normaliser or prefix space can be compiled")
        self.model = Tokenizer.from_str(vocabulary.decode()).model
        self.specials = [a["content"] for a in spec["added_tokens"]]
        self.letters = byte_characters()
        back = {c: b for b, c in enumerate(self.letters)}
        special = set(self.specials)
        self.tokens = [b"", *(bytes(back[c] for c in t) for t in spec["model"]["vocab"] if t not in special)]
        self.numbers = {t: i for i, t in enumerate(self.tokens)}  # 0: nothing stands before
        self.beginnings = {t[:k] for t in self.tokens for k in range(len(t) + 1)}
        self.most = max(most, 4)
        self.held: list[np.ndarray] = []  # state numbers that outlive a run
        self.reset([])

    def reset(self, live: list[int]) -> list[int]:
        """Forgets all states but those given and returns their new numbers."""
        held = [self.states[s] for s in live if s > _DEAD]
        # A state is packed: number of open borders, then (bytes since, token before, count there) of each, then the tail.
        self.states = [self._pack([0, 0, 0], b""), b""]
        self.known = {self.states[0]: _START}
        self.apart: dict[int, bool] = {}
        self.transitions = Transitions()
        for byte in range(256):
            self.transitions.put(_DEAD << 8 | byte, _DEAD << 8 | _ZERO)
        again = {s: self._number(h) for s, h in zip([s for s in live if s > _DEAD], held, strict=True)}
        return [again.get(s, s) for s in live]

    @staticmethod
    def _pack(borders: list[int], tail: bytes) -> bytes:
        return array("i", [len(borders), *borders]).tobytes() + tail

    def _number(self, state: bytes) -> int:
        number = self.known.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def _stands(self, before: int, token: int) -> bool:
        """Whether the model leaves a token apart from the one before it (or whole, at the start)."""
        result = self.apart.get(before << 20 | token)
        if result is None:
            left, right = self.tokens[before], self.tokens[token]
            merged = self.model.tokenize("".join([self.letters[b] for b in left + right]))
            result = len(merged) == (2 if before else 1) and len(merged[-1].value) == len(right)
            self.apart[before << 20 | token] = result
        return result

    def step(self, entry: int) -> int:
        """Compiles the transition of a state and a byte."""
        state = self.states[entry >> 8]
        size = 4 + 4 * int.from_bytes(state[:4], "little")
        borders = array("i", state[4:size])
        read = state[size:] + bytes([entry & 255])
        after, change, token = [], 0, 0
        for k in range(0, len(borders), 3):
            back, before, count = borders[k:k + 3]
            rest = read[len(read) - back - 1:]
            if not token:
                number = self.numbers.get(rest, 0)
                if number and self._stands(before, number):
                    change, token = count + 1, number
            if rest in self.beginnings:
                after += [back + 1, before, count]
        for k in range(2, len(after), 3):
            after[k] -= change
        tail = read[len(read) - after[0]:] if after else b""
        value = self._number(self._pack([*after, 0, token, 0], tail)) << 8 | change + _ZERO
        self.transitions.put(entry, value)
        return value

    def changes(self, data: np.ndarray, resets: np.ndarray) -> np.ndarray:
        """Count change of every byte; `resets` marks bytes that begin a piece, the first byte among them.

        What the bytes of a chunk change before a piece begins in it stands as one sum on its first byte.
        """
        self.held = []
        if len(self.states) > self.most:
            self.reset([])
        lanes = -(-len(data) // CHUNK)
        padded = np.zeros(lanes * CHUNK, np.int32)
        padded[:len(data)] = data
        enter = np.full(lanes * CHUNK, _NONE, np.int8)
        enter[:len(data)][resets] = _START
        enter[len(data):] = _DEAD
        bytes_of, enter = padded.reshape(lanes, CHUNK).T.copy(), enter.reshape(lanes, CHUNK).T.copy()
        out = np.full((CHUNK, lanes), _ZERO, np.uint8)
        begins = enter != _NONE
        heads = np.where(begins.any(0), begins.argmax(0), CHUNK)
        exits, _ = self._run(bytes_of, np.full(lanes, _DEAD, np.int64), np.full(lanes, CHUNK), enter, out)
        exits = self._exits(bytes_of, exits, heads == CHUNK)
        late = np.flatnonzero(heads > 0)
        _, sums = self._run(bytes_of[:, late], exits[late - 1], heads[late])
        changes = out.T.reshape(-1).astype(np.int64) - _ZERO
        changes[late * CHUNK] += sums
        return changes[:len(data)]

    def _exits(self, data: np.ndarray, exits: np.ndarray, through: np.ndarray) -> np.ndarray:
        """State in which every chunk ends, given those of chunks in which a piece begins; `through` marks the others.

        A chunk of the others is a map from states to states, known at some: at the begin of a piece, at what
        the chunk before ends in, and so on. All chunks extend their maps at once. The maps are composed by a scan, and
        once it comes from the true first state through all chunks they are known well enough. Maps that
        do not meet in a few rounds are extended only where the scan stopped.
        """
        if not through.any():
            return exits
        lanes = len(exits)
        place = np.flatnonzero(through)  # a place of a map: its chunk, the state it begins and the one it ends in
        first = ~through[place - 1]
        begin, end = np.where(first, exits[place - 1], _START), np.zeros(0, np.int64)
        chunk, rounds = place, 0
        while True:
            new = slice(len(end), None)
            self.held = [exits, begin, end]
            found, _ = self._run(data[:, chunk[new]], begin[new], np.full(len(chunk) - len(end), CHUNK))
            self.held = []
            end = np.concatenate([end, found])
            rounds += 1
            keys = chunk << 32 | begin
            order = np.argsort(keys)
            after = np.minimum(chunk + 1, lanes - 1)
            goes_on = (chunk + 1 < lanes) & through[after]
            wanted = after << 32 | end
            at = order[np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)]
            met = goes_on & (keys[at] == wanted)
            true = _reached(np.where(met, at, np.arange(len(keys))), np.flatnonzero(first), lanes)
            open_ends = goes_on & ~met
            if not (open_ends & true).any():
                exits[chunk[true]] = end[true]
                return exits
            more = np.unique(wanted[open_ends if rounds < GUESSES else open_ends & true])
            chunk = np.concatenate([chunk, more >> 32])
            begin = np.concatenate([begin, more & 0xFFFFFFFF])

    def _run(self, data: np.ndarray, states: np.ndarray, lengths: np.ndarray, enter: np.ndarray | None = None,
             out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Steps chunks together from the given states; returns the states after `lengths` bytes and the sums of changes."""
        longest = int(lengths.max(initial=0))
        if len(states) == 1 and enter is None:
            return self._run_one(data[:longest, 0], int(states[0]))
        order = np.argsort(-lengths, kind="stable")
        if (lengths != longest).any():
            data = data[:longest, order]
        states, sums = states[order].astype(np.int64), np.zeros(len(states), np.int64)
        going = np.searchsorted(-lengths[order], -np.arange(longest))  # chunks longer than the bytes read
        for at in range(longest):
            n = going[at]
            if enter is not None:
                states[:n] = np.where(enter[at, :n] != _NONE, enter[at, :n], states[:n])
            entries = (states[:n] << 8) + data[at, :n]
            values = self.transitions.find(entries)
            missing = values < 0
            if missing.any():
                if len(self.states) > self.most:
                    self._begin_anew([states, *self.held])
                    entries = (states[:n] << 8) + data[at, :n]
                    missing = self.transitions.find(entries) < 0
                for entry in np.unique(entries[missing]).tolist():
                    self.step(entry)
                values = self.transitions.find(entries)
            states[:n] = values >> 8
            sums[:n] += (values & 255) - _ZERO
            if out is not None:
                out[at] = values & 255
        back = np.argsort(order, kind="stable")
        return states[back], sums[back]

    def _begin_anew(self, arrays: list[np.ndarray]) -> None:
        """Forgets states that none of the arrays names; the arrays get the new numbers."""
        live = np.unique(np.concatenate(arrays))
        new = np.array(self.reset(live.tolist()), np.int64)
        for numbers in arrays:
            numbers[:] = new[np.searchsorted(live, numbers)]

    def _run_one(self, data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
        total = 0
        for byte in data.tolist():
            value = self.transitions.get(state << 8 | byte)
            if value < 0:
                value = self.step(state << 8 | byte)
            state = value >> 8
            total += (value & 255) - _ZERO
        return np.array([state], np.int64), np.array([total], np.int64)

    def count(self, texts: list[str], classes: np.ndarray) -> np.ndarray:
        """Tokens of every text."""
        owners, segments, extra = [], [], np.zeros(len(texts), np.int64)
        split = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        for row, text in enumerate(texts):
            parts = split.split(text) if split and any(s in text for s in self.specials) else [text]
            extra[row] = len(parts) - 1
            for part in parts:
                if part:
                    owners.append(row)
                    segments.append(part)
        if not segments:
            return extra
        whole = "".join(segments)
        points = code_points(whole)
        first = np.zeros(len(points), bool)
        begins = np.cumsum([0, *[len(s) for s in segments[:-1]]])
        first[begins] = True
        sizes = byte_lengths(points)
        places = np.cumsum(sizes) - sizes
        changes = self.changes(np.frombuffer(whole.encode(), np.uint8),
                               places[piece_starts(points, first, classes)])
        np.add.at(extra, owners, np.add.reduceat(changes, places[begins]))
        return extra


@lru_cache(maxsize=1)
def transducer(vocabulary: bytes) -> Transducer:
    """The transducer of a worker process: what one task compiled serves the next."""
    return Transducer(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `n_tokens` and `n_bytes` (UTF-8) of every text; a vocabulary is the content of a tokenizer file."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, class_runs()))  # a vocabulary: fixed size

    def measure() -> Measure:
        content, runs = shared.value
        machine, classes = transducer(content), class_table(runs)

        def apply(texts: list[str]) -> list[pa.Array]:
            return [pa.array(machine.count(texts, classes), pa.int64()),
                    pa.array([len(t.encode()) for t in texts], pa.int64())]

        return apply

    return with_text_columns(docs, text, COUNTED, measure, keep)
