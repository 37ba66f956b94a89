"""Toxicity by weak supervision.

Lexicon and pattern voters fire or stay silent on every text. Some lexicons are fixed word lists; others, of words and word
stems, are mined from the labelled rows that may be learned from and dealt into several lexicons, each a voter. No label votes:
from a first guess halfway between the voters' majority and the labels, a generative label model estimates by expectation-maximisation how often each voter fires in
either class, and how correlated the voters are beyond their class; correlated voters share their voices in the posterior. A
linear classifier is then trained on the posterior labels, reads votes and hashed words, and is calibrated to score all texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, logistic, sample_of_classes, sigmoid
from .store import materialize

#: At most so many labelled rows of each class are learned from.
SAMPLE = 10_000
#: Mined words and stems kept, by evidence.
LEXICON = 20_000
#: Standard deviations by which a mined word must prefer toxic texts.
EVIDENCE = 4.0
STEM = 5
#: Rows that the first guess of the posteriors counts as.
ANCHOR = 200
#: Voters that the mined words and the mined stems are dealt to, and buckets of hashed words that the classifier reads.
WORD_LEXICONS, STEM_LEXICONS, BUCKETS = 6, 4, 128

# Word lists of the lexicon voters.
INSULTS = frozenset("clown cretin dimwit dolt dumb dumbass fool idiot imbecile jerk loser moron nitwit stupid".split())
DEGRADING = frozenset("filth garbage parasite rat scum subhuman trash vermin worthless".split())
CONTEMPT = frozenset("disgusting pathetic repulsive revolting shameful vile".split())
PROFANE = frozenset("asshole bastard bitch crap cunt dick fuck fucking shit slut whore".split())
OTHER_LANGUAGES = frozenset(
    "abschaum arschloch dummkopf ekelhaft trottel wertlos connard débile dégoûtant imbécile minable ordure salaud "
    "asqueroso basura escoria estúpido idiota imbécil inútil patético".split()
)
HOSTILE = re.compile(r"\b(?:kill yourself|shut up|go to hell|drop dead|get lost|i hate you|you deserve (?:it|to))\b")
ADDRESSED = re.compile(
    r"\b(?:you|your|you're|du|tu|vous|usted)\b(?: \w+){0,3} (?:" + "|".join(sorted(INSULTS | DEGRADING | CONTEMPT | PROFANE)) + r")\b"
)
FIXED = (INSULTS, DEGRADING, CONTEMPT, PROFANE, OTHER_LANGUAGES)
_ANY = frozenset().union(*FIXED)
VOTERS = (*(f"lexicon_{x}" for x in ("insults", "degrading", "contempt", "profane", "other_languages")), "hostile", "addressed", "shouting", *(f"mined_words_{k}" for k in range(WORD_LEXICONS)), *(f"mined_stems_{k}" for k in range(STEM_LEXICONS)))
_WORD = re.compile(r"\w+")


@dataclass
class Lexicons:
    words: frozenset = field(default_factory=frozenset)
    stems: frozenset = field(default_factory=frozenset)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def stems(words: set[str]) -> set[str]:
    return {w[:STEM] for w in words if len(w) > STEM}


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets


def _dealt(found: set[str], lexicons: int) -> list[float]:
    """How many of the mined entries found belong to each of the lexicons."""
    out = [0.0] * lexicons
    for x in found:
        out[_bucket(x, lexicons)] += 1.0
    return out


def votes(text: str | None, lexicons: Lexicons) -> list[float]:
    """Hits of each voter, then the number of words, then the distinct words in each bucket; a null text has none of any."""
    found = tokens(text)
    distinct = set(found)
    fixed = distinct & _ANY
    out = [float(len(fixed & x)) for x in FIXED]
    low = text.lower() if text else ""
    out.append(float(len(HOSTILE.findall(low))) if " " in low else 0.0)
    out.append(float(len(ADDRESSED.findall(low))) if fixed else 0.0)
    out.append(1.0 if text and len(text) > 20 and text.isupper() else 0.0)
    out += _dealt(distinct & lexicons.words, WORD_LEXICONS) + _dealt(stems(distinct) & lexicons.stems, STEM_LEXICONS)
    out.append(float(len(found)))
    return out + _dealt(distinct, BUCKETS)


ROW = len(VOTERS) + 1 + BUCKETS


def _features(hits: np.ndarray) -> np.ndarray:
    """Constant; whether each voter fired, how often in logs, and how often for the length of the text; the same of all mined
    words and of all mined stems together; each bucket's share of the distinct words."""
    counts, words, buckets = hits[:, : len(VOTERS)], hits[:, len(VOTERS) : len(VOTERS) + 1], hits[:, len(VOTERS) + 1 :]
    first = len(FIXED) + 3
    mined = [counts[:, a:b].sum(axis=1, keepdims=True) for a, b in ((first, first + WORD_LEXICONS), (first + WORD_LEXICONS, None))]
    counts = np.concatenate([counts, *mined], axis=1)
    dense = counts / np.maximum(words, 20) * 100
    share = np.sqrt(buckets / np.maximum(buckets.sum(axis=1, keepdims=True), 1))
    return np.concatenate([np.ones((len(hits), 1)), (counts > 0).astype(float), np.log1p(counts), np.minimum(dense, 5), share], axis=1)


def mine(sample: DataFrame) -> Lexicons:
    """Words and stems whose texts are toxic far more often than chance. sample: (doc_id, text, y), near-copies once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                distinct = set(tokens(text))
                (toxic if y else clean).update({f"w{x}" for x in distinct} | {f"s{x}" for x in stems(distinct)})
        names = list(toxic.keys() | clean.keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([toxic[x] for x in part], pa.int64()), pa.array([clean[x] for x in part], pa.int64())], ["token", "toxic", "clean"]
            )

    sizes = dict(sample.groupBy("y").count().collect())
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    counts = sample.select("text", "y").mapInArrow(each, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    expected = (F.col("a") + F.col("b")) * share
    evidence = (F.col("a") - expected) / F.sqrt(expected * (1 - share) + 1e-9)
    rare = F.col("b") * share <= 0.03 * F.col("a") * (1 - share)
    kept = counts.where((F.col("a") >= 3) & rare).select("token", evidence.alias("z")).where(F.col("z") >= EVIDENCE)
    found = [r.token for r in kept.orderBy(F.desc("z"), "token").limit(LEXICON).collect()]
    return Lexicons(frozenset(x[1:] for x in found if x[0] == "w"), frozenset(x[1:] for x in found if x[0] == "s"))


@dataclass
class LabelModel:
    """Each voter's firing rate in either class, its share of voice, and the share of toxic texts."""

    toxic: np.ndarray
    clean: np.ndarray
    voice: np.ndarray
    prior: float

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        on = np.log(self.toxic / self.clean) * self.voice
        off = np.log((1 - self.toxic) / (1 - self.clean)) * self.voice
        return sigmoid(math.log(self.prior / (1 - self.prior)) + fired @ on + (1 - fired) @ off)


def majority(fired: np.ndarray, share: float) -> np.ndarray:
    """A first guess of the posteriors: the rows that most voters fire on, about ``share`` of all, are likely toxic."""
    count = fired.sum(axis=1)
    order = np.sort(count)[::-1]
    least = max(1.0, float(order[min(len(order) - 1, int(share * len(order)))])) if len(order) else 1.0
    return np.where(count >= least, 0.9, 0.02)


def label_model(fired: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[LabelModel, np.ndarray]:
    """The model and the rows' posteriors. fired: rows x voters, 0 or 1; start: a first guess of the posteriors, which counts as
    much as ANCHOR rows do, so that few rows cannot drift away from it. It converges near its start: from an uninformative
    guess it may follow a group of correlated voters instead."""
    start, voters, say = np.clip(start.astype(float), 0.02, 0.98), fired.shape[1], ANCHOR / (ANCHOR + len(fired))
    posterior = start
    voice = np.ones(voters)
    model = None
    for _ in range(rounds):
        n1, n0 = posterior.sum(), (1 - posterior).sum()
        toxic = np.clip((posterior @ fired + 0.5) / (n1 + 1), 1e-3, 1 - 1e-3)
        clean = np.clip(((1 - posterior) @ fired + 0.5) / (n0 + 1), 1e-3, 1 - 1e-3)
        left1, left0 = fired - toxic, fired - clean
        shared = (left1 * posterior[:, None]).T @ left1 + (left0 * (1 - posterior)[:, None]).T @ left0
        spread = np.sqrt(np.maximum(np.diag(shared), 1e-9))
        correlation = np.clip(shared / np.outer(spread, spread), 0, 1)
        voice = 1 / np.maximum(1.0, correlation.sum(axis=1))
        model = LabelModel(toxic, clean, voice, float(np.clip(n1 / len(fired), 1e-3, 1 - 1e-3)))
        posterior = (1 - say) * model.posterior(fired) + say * start
    return model, posterior


@dataclass
class Classifier:
    lexicons: Lexicons
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        hits = np.array([votes(t, self.lexicons) for t in texts], float).reshape(-1, ROW)
        return sigmoid(_features(hits) @ self.weights)


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, bound: int = SAMPLE) -> Classifier:
    """Fit on a bounded sample: at most 2 * bound ids go to the executors and as many rows of voter hits come back."""
    ids = sample_of_classes(labels, "toxic", modulus, remainder, bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))  # equal whole texts with one label count once
    sample = materialize(
        texts.join(F.broadcast(ids), "doc_id").groupBy(F.sha2(whole, 256).alias("whole"), "y").agg(F.min(F.struct("doc_id", "text", "y")).alias("x")).select("x.*")
    )
    lexicons = mine(sample)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [votes(t, lexicons) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "y", "hits"])

    found = sample.select("doc_id", "text", "y").mapInArrow(each, "doc_id long, y int, hits array<double>").orderBy("doc_id").collect()
    y, hits = np.array([r.y for r in found], float), np.array([r.hits for r in found], float).reshape(-1, ROW)
    columns = _features(np.zeros((1, ROW))).shape[1]
    if not len(found):
        return Classifier(lexicons, np.r_[-4.0, np.full(len(VOTERS), 3.0), np.zeros(columns - 1 - len(VOTERS))])
    fired = (hits[:, : len(VOTERS)] > 0).astype(float)
    _, posterior = label_model(fired, (majority(fired, float(y.mean())) + np.clip(y, 0.02, 0.98)) / 2)
    x = _features(hits)
    weights = logistic(x, posterior, ridge=0.3)
    return Classifier(lexicons, calibrated(weights, x @ weights, y))


def calibrated(weights: np.ndarray, odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The classifier's weights, stretched and shifted so that its scores are the labels' chances; its order of texts stays."""
    if y.min() == y.max():
        return weights
    shift, stretch = logistic(np.stack([np.ones(len(odds)), np.clip(odds, -12, 12)], axis=1), y, ridge=0.1)
    out = weights * max(stretch, 0.1)
    out[0] += shift
    return out


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``docs`` with a column ``toxicity``, 0 to 1, in place of one of that name; null and blank texts score as texts
    without hits do. Repeated rows repeat their score."""
    own = [c for c in docs.columns if c != "toxicity"]

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(classifier.scores([None if t is None or t != t else t for t in texts]))

    return docs.select(*own, score(F.col("text").cast("string")).alias("toxicity"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; learns from labels of rows whose crc32(doc_id) mod 5
    is not 0. Without labels the fixed lexicons alone decide. An empty table gives an empty result."""
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs, labels))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their own columns, whatever their names."""
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = scored(rows, learn(docs, labels)).where(F.col("toxicity") < threshold)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
