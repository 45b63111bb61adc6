"""Quality classifier learnt from trusted positives and unlabelled web text.

Nobody labels bad text reliably, so only documents marked good are trusted; all others are a mixture of good and
bad in unknown order. The classifier minimises the non-negative unbiased risk: the risk of calling unlabelled
text good, less what the good part of it would contribute at the class prior, and never below zero. The
prior is estimated from the same two samples, as the smallest ratio of unlabelled to positive texts above a score.

Features come from the text alone: shares of character kinds, word and line statistics, repetition, how well the
text compresses, and hashed byte pairs. Learning uses a bounded sample of rows chosen by a hash of the id
(`POSITIVES`, `UNLABELLED`); every text is scored whole.

Null texts count as empty; texts without words score 0. Repeated rows score alike, an empty table gives an
empty result, and input columns named like a result column are replaced. Without positives or without unlabelled
text nothing can be learnt: every score is 0.5 then, but for texts without words.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import Measure, with_text_columns
from .pretokens import code_points
from .shingles import WORD, WordNumbers, window_hashes

POSITIVES, UNLABELLED = 8_000, 16_000
"""Expected rows of the fitting sample: documents marked good, and documents without a label. Both are bounded whatever the
number of documents is; texts to score are not."""
THRESHOLD = 0.7
_PAIRS = 64
_DENSE = 24
SIZE = _DENSE + _PAIRS
_HASH_RANGE = 1 << 31
_UNITS, _BATCH, _STEP, _DECAY = 24, 128, 3e-3, 0.03
# These settings had the best accuracy of eight sets on teaching rows whose remainder is 3, learnt from those whose remainder is 0
# or 1; held-out rows had no part in it.
_EPOCHS, _FEWEST, _MOST = 100, 200, 2000
"""Passes over the positives, and bounds of the steps that gives."""
_SEEDS = (7, 8, 9)
_FARTHEST = 8.0

FEATURES = T.StructType([T.StructField("features", T.BinaryType())])
SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def held_out(key: Column) -> Column:
    """Rows that never teach: a quarter of all ids."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def text_features(text: str, numbers: WordNumbers) -> np.ndarray | None:
    """Numbers that describe a text; none for a text without words."""
    words = WORD.findall(text)
    if not words:
        return None
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    kinds = np.bincount(raw, minlength=256)
    points = code_points(text)
    small = code_points(text.lower())
    upper = float((points != small).mean()) if len(small) == len(points) else sum(map(str.isupper, text)) / len(text)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ids = numbers.of(words)
    _, counts = np.unique(ids, return_counts=True)
    windows = window_hashes(ids, 5)
    lines = [line for line in text.split("\n") if line.strip()]
    n, size = len(words), len(data)
    share = lambda characters: sum(int(kinds[ord(c)]) for c in characters) / size
    ends = sum(w[-1].isalnum() for w in words) / n
    starts = sum(w[0].isupper() for w in words) / n
    dense = [
        np.log1p(size) / 10, np.log1p(n) / 8, lengths.mean() / 10, lengths.std() / 10, min(lengths.max(), 200) / 50,
        upper, share("0123456789"), share("#*$%&"), share("|<>{}[]\\^~"), share("!?"), share(".,;:"), share("-_/=+@"),
        share("\"'()"), float((raw >= 0x80).mean()), share(" \t\n"), ends, starts,
        len(counts) / n, counts.max() / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        1 - len(np.unique(windows)) / len(windows) if len(windows) else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, np.log1p(size / max(1, len(lines))) / 10,
        len(zlib.compress(data, 1)) / (size + 12),
    ]
    pairs = (raw[:-1].astype(np.uint32) * 2654435761 + raw[1:].astype(np.uint32) * 40503) >> np.uint32(11) & np.uint32(_PAIRS - 1)
    hashed = np.sqrt(np.bincount(pairs, minlength=_PAIRS) / max(1, len(pairs)))
    return np.concatenate([np.array(dense, np.float64), hashed])


@dataclass(frozen=True)
class Network:
    """One hidden layer of rectified units."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def margin(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(rows @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias[0]

    def slopes(self, rows: np.ndarray, by_margin: np.ndarray) -> list[np.ndarray]:
        """Gradient of a mean over rows, from its derivative by their margins."""
        layer = np.maximum(rows @ self.hidden + self.hidden_bias, 0)
        scaled = by_margin / len(rows)
        back = np.outer(scaled, self.out) * (layer > 0)
        return [rows.T @ back, back.sum(0), layer.T @ scaled, np.array([scaled.sum()])]


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    networks: tuple[Network, ...]
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.centre) / self.scale, -_FARTHEST, _FARTHEST)
        margin = np.mean([n.margin(scaled) for n in self.networks], axis=0)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _sampled(key: Column, share: float) -> Column:
    """A share of the ids, the same ones in every run."""
    return F.pmod(F.xxhash64(key, F.lit("learn")), F.lit(_HASH_RANGE)) < int(share * _HASH_RANGE)


def samples(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of trusted positives and of unlabelled texts, in the order of their ids."""
    teaching = docs.filter(~held_out(docs[key])).select(docs[key].alias("_id"), docs[text].alias("_text"))
    marked = labels.filter(~held_out(labels[key])).select(labels[key].alias("_id"), labels[label].alias("_label"))
    good = marked.filter("_label = 1").select("_id").distinct()
    n_good, n_docs = good.count(), teaching.count()
    share = [min(1.0, wanted / max(1, n)) for wanted, n in ((POSITIVES, n_good), (UNLABELLED, n_docs))]
    # Both sides are cut down by the same hash before they meet.
    positive = teaching.filter(_sampled(F.col("_id"), share[0])).join(good.filter(_sampled(F.col("_id"), share[0])), "_id", "left_semi")
    unlabelled = teaching.filter(_sampled(F.col("_id"), share[1])).join(
        marked.filter(_sampled(F.col("_id"), share[1])).select("_id").distinct(), "_id", "left_anti")
    return tuple(_features_of(rows) for rows in (positive, unlabelled))


def _features_of(rows: DataFrame) -> np.ndarray:
    measured = with_text_columns(rows, "_text", FEATURES, _feature_measure, ["_id"]).filter("features is not null")
    found = measured.toArrow().to_pydict()  # a sample of known expected size
    ordered = sorted(zip(found["_id"], found["features"], strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return np.array([np.frombuffer(f, np.float32) for _, f in ordered], np.float64).reshape(-1, SIZE)


def _feature_measure() -> Measure:
    numbers = WordNumbers()

    def apply(texts: list[str]) -> list[pa.Array]:
        rows = [text_features(t, numbers) for t in texts]
        return [pa.array([None if r is None else r.astype(np.float32).tobytes() for r in rows], pa.binary())]

    return apply


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled scores: the best bin above a threshold, with a margin for its size."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 45))
    p = (positive[:, None] >= cuts).mean(0)
    u = (unlabelled[:, None] >= cuts).mean(0)
    slack = 1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled))
    best = int(np.argmin((u + slack) / p))
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def learn(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Networks of least non-negative unbiased risk, with the logistic loss; they differ in their seeds only."""
    if len(positive) == 0 or len(unlabelled) == 0:
        nothing = Network(np.zeros((SIZE, 1)), np.zeros(1), np.zeros(1), np.zeros(1))
        return Model(np.zeros(SIZE), np.ones(SIZE), (nothing,), 0.5)
    # Scaled by the trusted texts: what is odd for them is far out.
    centre, scale = positive.mean(0), positive.std(0) + 1e-3
    p, u = (np.clip((x - centre) / scale, -_FARTHEST, _FARTHEST) for x in (positive, unlabelled))
    steps = int(np.clip(_EPOCHS * len(p) / _BATCH, _FEWEST, _MOST))
    # First half of the two samples is told apart; how the other half's scores spread gives the prior.
    apart = _descend(p[::2], u[::2], None, max(60, steps // 8), _SEEDS[0])
    prior = estimate_prior(apart.margin(p[1::2]), apart.margin(u[1::2])) if min(len(p), len(u)) > 1 else 0.5
    return Model(centre, scale, tuple(_descend(p, u, prior, steps, seed) for seed in _SEEDS), prior)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, seed: int) -> Network:
    """Adam on batches. Without a prior the samples are told apart, with one the risk is minimised."""
    rng = np.random.default_rng(seed)
    size = p.shape[1]
    values = [rng.normal(0, np.sqrt(2 / size), (size, _UNITS)), np.zeros(_UNITS),
              rng.normal(0, np.sqrt(1 / _UNITS), _UNITS), np.zeros(1)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for time in range(1, steps + 1):
        a, b = p[rng.integers(len(p), size=_BATCH)], u[rng.integers(len(u), size=_BATCH)]
        net = Network(*values)
        at_p, at_u = net.margin(a), net.margin(b)
        as_good, as_bad = net.slopes(a, _sigmoid(at_p) - 1), net.slopes(a, _sigmoid(at_p))
        mixed = net.slopes(b, _sigmoid(at_u))
        if prior is None:
            slope = [g + m for g, m in zip(as_good, mixed, strict=True)]
        else:
            bad_part = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
            if bad_part >= 0:
                slope = [prior * (g - n) + m for g, n, m in zip(as_good, as_bad, mixed, strict=True)]
            else:  # over-fitted: this part of the risk is led back instead of lowered further
                slope = [prior * n - m for n, m in zip(as_bad, mixed, strict=True)]
        rate = _STEP * (1 - 0.9 * time / steps)
        for k, g in enumerate(slope):
            g = g + _DECAY * values[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            values[k] = values[k] - rate * first[k] / (1 - 0.9 ** time) / (np.sqrt(second[k] / (1 - 0.999 ** time)) + 1e-8)
    return Network(*values)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    return learn(*samples(docs, labels, key, text, label))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None
          ) -> DataFrame:
    """Adds `score`, the chance that a text is good, and `predicted`."""

    def measure() -> Measure:
        numbers = WordNumbers()

        def apply(texts: list[str]) -> list[pa.Array]:
            rows = [text_features(t, numbers) for t in texts]
            scores = np.zeros(len(rows))
            full = [i for i, r in enumerate(rows) if r is not None]
            if full:
                scores[full] = model.score(np.array([rows[i] for i in full], np.float32).astype(np.float64))
            return [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))]

        return apply

    return with_text_columns(docs, text, SCORED, measure, keep)
