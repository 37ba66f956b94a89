"""Quality scores from preference pairs by the Bradley-Terry model.

Every text is read once, into a few dozen numbers. From a bounded sample of labelled rows come pairs (better, worse); a
document's strength is linear in the ranges that its features fall into, and the probability that one document is better
than another is the logistic function of the difference of their strengths. The quantile of the sample's strengths at the
share of label 0 becomes the point where the score is one half.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, logistic, sample_of_classes, sigmoid
from .store import materialize

#: At most so many labelled rows of each class are learned from.
SAMPLE = 10_000
#: Opponents that each document of the rarer class meets.
OPPONENTS = 6
RANGES = 10

_CLASSES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": (9, 10, 11, 12, 13, 32),
    "stop": tuple(b".,;:"),
    "bang": tuple(b"!?"),
    "bar": tuple(b"|"),
    "mark": tuple(b"*#$%&@^~"),
    "bracket": tuple(b"<>[]{}()=+_/\\\"'-`"),
    "wide": range(128, 256),
}
_OF_BYTE = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _OF_BYTE[list(_bytes), _k] = 1
FEATURES = 22


def features(text: str | None) -> list[float]:
    """Null and blank texts give zeros."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    lower, upper, digit, space, stop, bang, bar, mark, bracket, wide = np.bincount(raw, minlength=256) @ _OF_BYTE
    size = len(raw)
    counts = Counter(words)
    lines = text.split("\n")
    lengths = [len(w) for w in words]
    return [
        math.log1p(n),
        sum(lengths) / n,
        upper / (lower + upper + 1),
        mark / n,
        bang / n,
        bar / n,
        bracket / n,
        stop / n,
        digit / size,
        wide / size,
        space / size,
        len(counts) / n,
        len(counts) / n**0.8,
        counts.most_common(1)[0][1] / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / n,
        len(set(lines)) / len(lines),
        math.log1p(len(lines)),
        n / len(lines),
        sum(1 for x in lengths if x <= 3) / n,
        math.log1p(max(lengths)),
        sum(1 for w in counts if w.isupper()) / len(counts),
    ]


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, features)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, features array<double>")


@dataclass
class Ranking:
    """Range limits of each feature, the strength of each range, and the strength that scores one half."""

    limits: list[np.ndarray]
    strength: np.ndarray
    middle: float

    def design(self, x: np.ndarray) -> np.ndarray:
        return one_hot(x, self.limits)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.design(x) @ self.strength - self.middle)


def one_hot(x: np.ndarray, limits: list[np.ndarray]) -> np.ndarray:
    """A rising step for each limit passed, so that neighbouring ranges share what they learn."""
    return np.concatenate([(x[:, k, None] >= edges[None, :]).astype(np.float64) for k, edges in enumerate(limits)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, share_bad: float, seed: int = 6) -> Ranking:
    """x: features of sampled rows; y: their labels; share_bad: label 0's share of all labels. Without rows of both labels all
    texts have one strength, which passes where no row is bad."""
    if not len(x):
        return Ranking([np.zeros(0)] * x.shape[1], np.zeros(0), -2.0)
    limits = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, RANGES + 1)[1:-1])) for k in range(x.shape[1])]
    limits = [np.unique(np.r_[e, np.quantile(x[y == 0, k], (0.25, 0.5, 0.75))]) if (y == 0).any() else e for k, e in enumerate(limits)]
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    if not len(good) or not len(bad):
        return Ranking(limits, np.zeros(sum(map(len, limits))), 0.0 if len(bad) else -2.0)
    rng = np.random.default_rng(seed)
    meets = OPPONENTS * max(len(good), len(bad))
    better = good[rng.integers(0, len(good), meets)]
    worse = np.tile(bad, -(-meets // len(bad)))[:meets]
    design = one_hot(x, limits)
    strength = logistic(design[better] - design[worse], np.ones(meets), ridge=2.0)
    own = design @ strength
    weights = np.where(y == 1, (1 - share_bad) / len(good), share_bad / len(bad))
    order = np.argsort(own, kind="stable")
    reached = np.cumsum(weights[order])
    middle = own[order][min(int(np.searchsorted(reached, share_bad * reached[-1])), len(order) - 1)]
    return Ranking(limits, strength, float(middle))


def learn(rows: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, bound: int = SAMPLE) -> Ranking:
    """Fit on the features of a bounded sample: at most 2 * bound ids are sent to the executors, as many rows come back."""
    sample = sample_of_classes(labels, "quality", modulus, remainder, bound)
    known = labels.where(~held_out(F.col("doc_id"), modulus, remainder) & F.col("quality").isin(0, 1))
    share = known.agg(F.avg(1 - F.col("quality"))).first()[0]
    found = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("features").alias("features")).orderBy("doc_id").collect()
    x = np.array([r.features for r in found], float).reshape(-1, FEATURES)
    return fit(x, np.array([r.y for r in found], int), float(share or 0.0))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from labels of rows whose crc32(doc_id) mod 3 is not 1. Null and blank texts score as a text without words does;
    repeated rows repeat their score; without labels of both classes every text scores alike. An empty table gives an
    empty result.
    """
    rows = materialize(feature_rows(docs))
    ranking = learn(rows, labels)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            scores = ranking.scores(flat.reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return rows.mapInArrow(each, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
