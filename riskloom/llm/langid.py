"""Language identification by interpolated Kneser-Ney character models, one for each language.

Texts become runs of lower-case letters with single breaks between them. Every four-letter sequence of the texts that may
be learned from is counted; continuation counts of the shorter ones follow from the distinct longer ones. All levels of all
languages are tables: sequence hashes (16 bits a letter) with probabilities, contexts with back-off weights; nothing is cut.

What scoring needs most goes to the tasks as sorted hash arrays: the most frequent sequences with their log probability in
every language, as many as fit TABLE numbers. Sequences of a text that the arrays do not hold, rare and unknown ones, are
scored by joins with the tables instead, so the arrays' size decides about speed and never about a result. A text gets the
language with the lowest cross-entropy per letter; texts that no model explains about as well as it explains learning texts
are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import held_out
from .store import materialize

ORDER = 4
#: Log probabilities that the tasks hold at most: sequences times languages.
TABLE = 16_000_000
#: Share of the learning texts that rejection is calibrated to reject, and bins a round in which their cross-entropies are counted.
REJECTED = 0.001
BINS = 1024
UNDECIDED = "und"
#: Characters per step; longer texts are read in pieces, each with the letters before it.
STEP = 1_000_000

_EDGE, _BREAK = 1, 0
_EDGE_TEXT = "\uffff" * (ORDER - 1)
_MASKS = [np.uint64((1 << (16 * n)) - 1) for n in range(ORDER + 1)]
_letters: np.ndarray | None = None


def _letter_codes() -> np.ndarray:
    """16-bit code of each code point: letters by value, folded above the basic plane; 1 for the edge; else 0."""
    global _letters
    if _letters is None:
        codes = np.zeros(0x110000, np.uint16)
        points = np.fromiter((i for i in range(0x110000) if chr(i).isalpha()), np.int64)
        folded = points & 0xFFFF
        codes[points] = np.where(folded < 2, folded + 2, folded)
        codes[0xFFFF] = _EDGE
        _letters = codes
    return _letters


def _codes(text: str) -> np.ndarray:
    return _letter_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _lower(text: str) -> str:
    return text.lower().replace("\uffff", " ")


def _keys(codes: np.ndarray) -> np.ndarray:
    """For each code the ORDER codes that end with it."""
    wide = codes.astype(np.uint64)
    key = wide.copy()
    for back in range(1, ORDER):
        key[back:] |= wide[:-back] << np.uint64(16 * back)
    return key


def _together(rows: list[int], texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    codes = _codes("".join(_EDGE_TEXT + _lower(t) + " " for t in texts))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _BREAK) | (codes[:-1] > _EDGE)
    codes = codes[keep]
    edge = codes == _EDGE
    starts = edge & ~np.r_[False, edge[:-1]]
    number = np.asarray(rows)[np.cumsum(starts) - 1]
    if not edge.all():
        yield number[~edge], _keys(codes)[~edge]


def _in_pieces(row: int, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    text, last = _lower(text) + " ", np.full(ORDER - 1, _EDGE, np.uint16)
    for at in range(0, len(text), STEP):
        codes = _codes(text[at : at + STEP])
        codes = codes[(codes != _BREAK) | (np.r_[last[-1], codes[:-1]] > _EDGE)]
        if len(codes):
            joined = np.r_[last, codes]
            yield np.full(len(codes), row), _keys(joined)[ORDER - 1 :]
            last = joined[-(ORDER - 1) :]


def sequences(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, ORDER-letter sequences as 64-bit keys), one for each letter and break after the text's edge."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        if text and len(text) > STEP:
            yield from _in_pieces(row, text)
        elif text:
            rows.append(row)
            parts.append(text)
            size += len(text)
            if size >= STEP:
                yield from _together(rows, parts)
                rows, parts, size = [], [], 0
    if rows:
        yield from _together(rows, parts)


def _has_letter(keys: np.ndarray) -> np.ndarray:
    return (keys & _MASKS[1]) > _EDGE


def _counts(texts: DataFrame) -> DataFrame:
    """(lang, key, n) over all rows of (lang, text)."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out(lang: str) -> pa.RecordBatch:
            keys, n = merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "key", "n"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for _, keys in sequences([t for t, x in zip(texts, langs) if x == lang]):
                    own = held.setdefault(lang, [])
                    own.append(np.unique(keys, return_counts=True))
                    if len(own) >= 16:
                        held[lang] = [merged(own)]
                        if len(held[lang][0][0]) > 2_000_000:  # the aggregate after this one adds up what is sent twice
                            yield out(lang)
        for lang in sorted(held):
            yield out(lang)

    return texts.select("lang", "text").mapInArrow(each, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _suffix(key: Column, n: int) -> Column:
    return key.bitwiseAND(F.lit(int(_MASKS[n]))) if n < ORDER else key


@dataclass
class Models:
    """The languages' levels as tables, and the sorted array of the most frequent sequences with their log probabilities.

    levels[n - 1]: ((lang, key, p) of sequences of n letters, (lang, context, weight) of what n letters back off with)."""

    names: list[str]
    letters: int
    levels: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))


def kneser_ney(counts: DataFrame, letters: int) -> list[tuple[DataFrame, DataFrame]]:
    """The levels of 1 to ORDER letters from (lang, key, n); ``letters``: size of the alphabet that the shortest level is
    interpolated with. Each level has one absolute discount a language, from how many of its counts are one and two."""
    by_length = [counts.select("lang", "key", F.col("n").cast("double").alias("n"))]
    for n in range(ORDER - 1, 0, -1):
        longer = by_length[0].select("lang", _suffix(F.col("key"), n).alias("key"))
        by_length.insert(0, materialize(longer.groupBy("lang", "key").agg(F.count("*").cast("double").alias("n"))))
    levels: list[tuple[DataFrame, DataFrame]] = []
    for n, own in enumerate(by_length, 1):
        ones, twos = (F.sum((F.col("n") == x).cast("double")) for x in (1, 2))
        usual = F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5)
        discounts = own.groupBy("lang").agg(usual.alias("discount"))
        own = own.withColumn("context", F.shiftrightunsigned("key", 16))
        contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(F.broadcast(discounts), "lang")
        contexts = materialize(contexts.withColumn("weight", F.col("discount") * F.col("kinds") / F.col("total")))
        rows = own.join(contexts, ["lang", "context"])
        if n == 1:
            rows = rows.withColumn("lower", F.lit(1.0 / letters))
        else:
            shorter = levels[-1][0].select("lang", F.col("key").alias("suffix"), F.col("p").alias("lower"))
            rows = rows.withColumn("suffix", _suffix(F.col("key"), n - 1)).join(shorter, ["lang", "suffix"])
        p = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("lower")
        levels.append((materialize(rows.select("lang", "key", p.alias("p"))), contexts.select("lang", "context", "weight")))
    return levels


def log_probabilities(keys: DataFrame, models: Models) -> DataFrame:
    """(key) -> (key, k, logp): of the last letter of each key after the ORDER - 1 before it, in language number k."""
    numbered = F.posexplode(F.array(*map(F.lit, models.names))).alias("k", "lang")
    rows = keys.select("key", numbered)
    for n, (found, contexts) in enumerate(models.levels, 1):
        rows = rows.withColumn("_part", _suffix(F.col("key"), n)).withColumn("_context", F.shiftrightunsigned("_part", 16))
        rows = rows.join(found.select("lang", F.col("key").alias("_part"), F.log("p").alias(f"p{n}")), ["lang", "_part"], "left")
        rows = rows.join(contexts.select("lang", F.col("context").alias("_context"), F.log("weight").alias(f"w{n}")), ["lang", "_context"], "left")
        rows = rows.drop("_part", "_context")
    logp = F.lit(-float(np.log(models.letters)))
    for n in range(1, ORDER + 1):
        logp = F.coalesce(F.col(f"p{n}"), F.coalesce(F.col(f"w{n}"), F.lit(0.0)) + logp)
    return rows.select("key", "k", logp.alias("logp"))


def _in_order(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, k, value) -> (by, values in the order of k)."""
    return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda x: x[value]).alias("values"))


def learn(docs: DataFrame, modulus: int = 4, remainder: int = 2, table: int = TABLE) -> Models:
    """Counts cover every row that may be learned from, every language and every sequence. The driver gets the languages'
    names, how many sequences there are of each count up to 100,000, and at most ``table`` log probabilities."""
    known = _known(docs, modulus, remainder).where("own is not null")
    counts = materialize(_counts(known.select(F.col("own").alias("lang"), "text")))
    names = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not names:
        return Models([], 1)
    letters = counts.select(_suffix(F.col("key"), 1)).distinct().count() + 1
    models = Models(names, letters, kneser_ney(counts, letters))
    totals = materialize(counts.groupBy("key").agg(F.sum("n").alias("n")))
    most, least, reached = max(1, table // len(names)), 1, 0
    for r in totals.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).collect():
        reached += r["count"]
        if reached > most:
            least = r.n + 1
            break
    kept = _in_order(log_probabilities(totals.where(F.col("n") >= least).select("key"), models), "key", "logp") if least <= 100_000 else None
    if kept is not None:
        found = kept.select("key", F.col("values").cast("array<float>")).toArrow()
        keys = found.column(0).to_numpy().view(np.uint64)
        rows = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in found.column(1).chunks] or [np.zeros(0, np.float32)])
        order = np.argsort(keys, kind="stable")
        models.known, models.table = keys[order], rows.reshape(-1, len(names))[order]
    models.limit = np.full(len(names), np.inf)
    return models


def _known(docs: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, text, own): own is the language where it may be learned from."""
    doc_id, lang, text = F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.when(text.isNotNull() & ~held_out(doc_id, modulus, remainder), lang).alias("own"))


class _Lookup:
    """Row of each key in the sorted array, or -1: one probe of a hash table, binary search for what it doesn't hold."""

    def __init__(self, known: np.ndarray):
        self.known, bits = known, max(10, int(len(known) * 4).bit_length())
        self.slot = lambda k: (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.slots[self.slot(known)] = np.arange(len(known), dtype=np.int32)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        rows = self.slots[self.slot(keys)]
        if not len(self.known):
            return rows
        wrong = np.nonzero((rows < 0) | (self.known[rows] != keys))[0]
        if len(wrong):
            at = np.minimum(np.searchsorted(self.known, keys[wrong]), len(self.known) - 1)
            rows[wrong] = np.where(self.known[at] == keys[wrong], at, -1)
        return rows


def _read(texts: list[str | None], lookup: _Lookup, table: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list]:
    """Sums of the held log probabilities (texts x languages), steps and letters of each text, and the sequences that are not
    held, with how often they occur."""
    total, steps, letters = np.zeros((len(texts), languages)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    rest: list[list] = [[] for _ in texts]
    for number, keys in sequences(texts):
        rows, first = lookup.rows(keys), int(number[0])
        number = number - first
        width = int(number[-1]) + 1
        span = slice(first, first + width)
        steps[span] += np.bincount(number, minlength=width)
        letters[span] += np.bincount(number[_has_letter(keys)], minlength=width)
        hit = rows >= 0
        for k in range(languages):
            total[span, k] += np.bincount(number[hit], table[rows[hit], k], width)
        others, of = keys[~hit], number[~hit]
        for i, part in zip(np.unique(of), np.split(others, np.nonzero(np.diff(of))[0] + 1)) if len(of) else ():
            rest[first + i].append(part)
    found = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for x in rest]
    return total, steps, letters, [k.view(np.int64) for k, _ in found], [n.astype(np.int64) for _, n in found]


def cross_entropies(rows: DataFrame, models: Models) -> DataFrame:
    """(doc_id, text, own) -> (doc_id, own, totals, steps, letters): each text's log probability in every language."""
    languages = len(models.names)
    held = rows.sparkSession.sparkContext.broadcast((models.known, models.table))  # at most TABLE numbers

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *(len(x) for x in arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, table = _Lookup(held.value[0]), held.value[1]
        for batch in batches:
            total, steps, letters, keys, n = _read(batch.column(1).to_pylist(), lookup, table, languages)
            sums = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, languages, dtype=np.int32)), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), sums, pa.array(steps), pa.array(letters), lists(keys), lists(n)], ["doc_id", "own", "totals", "steps", "letters", "keys", "n"]
            )

    schema = "doc_id long, own string, totals array<double>, steps long, letters long, keys array<long>, n array<long>"
    read = materialize(rows.select("doc_id", "text", "own").mapInArrow(each, schema).withColumn("row", F.monotonically_increasing_id()))
    rest = read.select("row", F.explode(F.arrays_zip("keys", "n")).alias("x")).select("row", "x.keys", "x.n").withColumnRenamed("keys", "key")
    scored = _in_order(log_probabilities(rest.select("key").distinct(), models), "key", "logp")
    sums = rest.join(scored, "key").select("row", "n", F.posexplode("values").alias("k", "logp")).groupBy("row", "k").agg(F.sum(F.col("n") * F.col("logp")).alias("logp"))
    more = _in_order(sums, "row", "logp")
    both = F.when(F.col("values").isNull(), F.col("totals")).otherwise(F.zip_with("totals", "values", lambda a, b: a + b))
    return materialize(read.drop("keys", "n").join(more, "row", "left").select("doc_id", "own", both.alias("totals"), "steps", "letters"))


def percentiles(values: DataFrame, share: float, bins: int = BINS) -> dict[int, float]:
    """(at, x) -> by at, the exact percentile of all its rows' x, between two of them where it lies there. Each round counts rows in ``bins``
    equal steps between the bounds that hold what is looked for, and goes on within one bin; the driver gets a count a bin."""
    first = values.groupBy("at").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    place = {r["at"]: share * (r.n - 1) for r in first}
    # by at and rank: the bounds that hold it, and its rank between them
    held = {(r["at"], k): (r.low, r.high, k) for r in first for k in (floor(place[r["at"]]), ceil(place[r["at"]]))}
    while open_ := {(at, low, high) for (at, _), (low, high, _) in held.items() if low < high}:
        bounds = values.sparkSession.createDataFrame(sorted(open_), "at int, low double, high double")
        inside = values.join(F.broadcast(bounds), "at").where("x BETWEEN low AND high")
        step = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
        counted = inside.groupBy("at", "low", "high", step.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        found: dict[tuple, list] = {}
        for r in sorted(counted.collect(), key=lambda r: r.bin):
            found.setdefault((r["at"], r.low, r.high), []).append(r)
        for name, (low, high, k) in held.items():
            for r in found.get((name[0], low, high), ()) if low < high else ():
                if k < r.n:
                    held[name] = (r.least, r.most, k)
                    break
                k -= r.n
    ends = {at: (held[at, floor(x)][0], held[at, ceil(x)][0]) for at, x in place.items()}
    return {at: one + (place[at] - floor(place[at])) * (two - one) for at, (one, two) in ends.items()}


def calibrated(models: Models, found: DataFrame) -> Models:
    """``models`` with the cross-entropy above which a text is rejected: what nearly all learning texts stay below, and a twentieth. Every
    learning text counts."""
    at = F.array_position(F.array(*map(F.lit, models.names)), F.col("own")).cast("int")
    entropy = -F.element_at("totals", at) / F.greatest("steps", F.lit(1))
    learned = found.where("own is not null and letters > 0").select(at.alias("at"), entropy.alias("x"))
    for place, limit in percentiles(learned, 1 - REJECTED).items():
        models.limit[place - 1] = limit * 1.05
    return models


def decided(found: DataFrame, models: Models) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) from log probabilities."""
    names, limit = models.names, models.limit

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, letters = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            totals = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
            entropy = -totals / np.maximum(steps, 1)[:, None]
            best = entropy.argmin(axis=1)
            lowest = entropy[np.arange(len(best)), best]
            odds = np.exp(-(entropy - lowest[:, None]) * np.minimum(letters, 60)[:, None])
            score = np.where(letters > 0, 1 / odds.sum(axis=1), 0.0)
            chosen = [names[b] if n else UNDECIDED for b, n in zip(best, letters)]
            rejected = (letters == 0) | (lowest > limit[best])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chosen, pa.string()), pa.array(score), pa.array(np.where(letters > 0, lowest, np.nan), from_pandas=True), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return found.select("doc_id", "totals", "steps", "letters").mapInArrow(each, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def languages(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("own"))
    return decided(cross_entropies(rows, models), models) if models.names else _undecided(rows)


def _undecided(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.lit(UNDECIDED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))


def identify(docs: DataFrame, table: int = TABLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) for every row of ``docs``.

    Learns from rows with a lang whose crc32(doc_id) mod 4 is not 2. Texts that are null or have no letter are ``und`` with
    score 0; where nothing can be learned, all are. Equal cross-entropies go to the first language by name. rejected marks
    texts that the chosen model explains worse than nearly all its learning texts; they keep their lang_pred. Repeated rows
    repeat their result. An empty table gives an empty result.
    """
    models = learn(docs, table=table)
    rows = _known(docs, 4, 2)
    if models.names:
        found = cross_entropies(rows, models)
        named = decided(found, calibrated(models, found))
    else:
        named = _undecided(rows)
    return named.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
