"""Near copies by SimHash probing, widened by MinHash bands, and decided by the exact similarity of their word sequences.

A text is the set of its five-word sequences; equal sets are one node. The fingerprint operator (``simhash``) proposes pairs of
nodes whose fingerprints lie within three bits. Near copies at a similarity of 0.8 differ in some ten of 64 bits, which no
partition of 64 bits can probe without meeting a large part of all pairs, so MinHash bands say which other nodes can have a
partner at all: texts with a similarity of 0.8 share none of the bands with a chance of about 3 in a million, of more similar ones
hardly ever. Among those nodes, two can only be similar if they share one of their rarest sequences, early enough in both; such
pairs are compared. The exact Jaccard similarity of the whole sets decides, and components are taken over the pairs that pass.

The nodes that share a sequence are compared in rounds, each with those a few places on, then with those four times as far, until
the ends are reached. Every round leaves out pairs that the rounds before have put into one component, so a large group of near
copies never gives all its pairs, and no pair that could still join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import star_components
from .simhash import SEED, first_of_each
from .store import materialize

WORDS = 5
BANDS, BAND_ROWS = 32, 5
#: Each node of a band value is compared with so many next ones at first, then with so many times more in each round.
NEXT, WIDER = 2, 4

_rng = np.random.default_rng(SEED)
_XORS, _FACTORS = (_rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) for _ in range(2))
_FACTORS = _FACTORS * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word sequences; a shorter text is one sequence, a blank one has none."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < words:
        parts = [b" ".join(tokens)]
    else:
        parts = [b" ".join(s) for s in zip(*(tokens[i:] for i in range(words)))]
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(p, SEED) for p in parts]), ">u8").astype(np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """One value for each band; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(low, ((own[at : at + 1024, None] ^ _XORS) * _FACTORS).min(axis=0), out=low)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in low.reshape(BANDS, BAND_ROWS).T:
        out = (out ^ row) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, mark, node, fp, bands): node is the hash of the whole set, fp its fingerprint, mark the hash of the text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, values, ends = [], [], [], [0]
            for text in batch.column(1):
                own = shingles(text.as_py(), words)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                prints.append(simhash.majority(own))
                values.append(bands(own))
                ends.append(ends[-1] + len(values[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(np.array(prints, np.int64)), lists], ["doc_id", "mark", "node", "fp", "bands"])

    return _texts(docs).mapInArrow(each, "doc_id long, mark long, node long, fp long, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark")).where("doc_id is not null")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut between cells."""
    rest = None
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if rest is not None:
            now = [np.concatenate([x, y]) for x, y in zip(rest, now)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        rest = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now]
    if rest is not None and len(rest[0]):
        yield rest


def _candidates(nodes: DataFrame) -> DataFrame:
    """(node): nodes that share a band value with another one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, node in _whole_cells(batches):
            new = np.r_[True, cell[1:] != cell[:-1]]
            alone = new & np.r_[new[1:], True]
            yield pa.RecordBatch.from_arrays([pa.array(node[~alone])], ["node"])

    cells = nodes.select(F.explode("bands").alias("cell"), "node").repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(each, "node long").distinct()


def _prefixes(texts: DataFrame, words: int) -> DataFrame:
    """(cell, place, node, size, position): the rarest sequences of each node that any partner must share one of, as cells of the nodes
    that have them; position counts all rarer sequences of the node, place runs through a cell by size.

    With sequences in order of how many nodes have them, two sets of similarity 0.8 share one among the first size - 0.8 * size + 1
    of either. Sequences of one node only come first, meet nothing, and are counted without being sorted."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = shingles(text.as_py(), words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node, np.int64)), pa.array(np.full(len(own), len(own), np.int64)), pa.array(own.view(np.int64))], ["node", "size", "token"])

    tokens = materialize(texts.mapInArrow(each, "node long, size long, token long"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    by_node = tokens.join(shared, "token").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own"))
    alone = F.col("size") - F.size("own")
    length = F.col("size") - F.ceil(F.col("size") * 4 / 5) + 1 - alone
    first = by_node.where(length > 0).select("node", "size", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), length.cast("int"))).alias("k", "x"))
    rows = first.select(F.col("x.token").alias("cell"), "node", "size", (F.col("alone") + F.col("k")).alias("position"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(cell):
                continue
            starts = np.nonzero(np.r_[True, cell[1:] != cell[:-1]])[0]
            place = np.arange(len(cell)) - np.repeat(starts, np.diff(np.r_[starts, len(cell)]))
            if cell[0] == last:
                place[: starts[1] if len(starts) > 1 else len(cell)] += at
            last, at = cell[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), *batch.columns[1:]], ["cell", "place", "node", "size", "position"])

    ordered = rows.repartition("cell").sortWithinPartitions("cell", "size", "node")
    return ordered.mapInArrow(placed, "cell long, place long, node long, size long, position long")


def _proposed(members: DataFrame, after: int, upto: int) -> DataFrame:
    """(u, v): nodes of a cell that are in different components, lie more than ``after`` and at most ``upto`` places apart, and can be
    similar by their sizes and by how much of each set comes after this cell's sequence. members: those of ``_prefixes`` with root. A
    task holds the last ``upto`` rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            old = 0 if kept is None else len(kept[0])
            if kept is not None:
                now = [np.concatenate([x, y]) for x, y in zip(kept, now)]
            cell, node, size, position, root = now
            for d in range(after + 1, min(upto, len(cell) - 1) + 1):
                first = max(0, old - d)  # pairs of two old rows are done
                a, b = slice(first, len(cell) - d), slice(first + d, len(cell))
                hit = np.nonzero((cell[a] == cell[b]) & (root[a] != root[b]))[0]
                if len(hit):
                    one, other = hit + first, hit + first + d
                    left = np.minimum(size[one] - position[one], size[other] - position[other])
                    can = (9 * left >= 4 * (size[one] + size[other])) & (5 * size[one] >= 4 * size[other])
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[one], node[other])[can]), pa.array(np.maximum(node[one], node[other])[can])], ["u", "v"])
            kept = [x[-upto:] for x in now]

    ordered = members.repartition("cell").sortWithinPartitions("cell", "place").select("cell", "node", "size", "position", "root")
    return ordered.mapInArrow(each, "u long, v long")


def _close_prints(nodes: DataFrame, threshold: int = simhash.THRESHOLD) -> DataFrame:
    """(u, v), u < v: nodes of equal fingerprints with the first of them, and first nodes of fingerprints that the operator links."""
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    same = nodes.join(heads, "fp").select(F.col("head").alias("u"), F.col("node").alias("v"))
    total = heads.count()
    if total > 1:
        links = simhash.verified_links(simhash.meetings(heads, simhash.plan_parts(heads, total), threshold), threshold)
        one, other = (heads.select(F.col("fp").alias(n), F.col("head").alias(f"{n}_head")) for n in "uv")
        far = links.join(one, "u").join(other, "v").select(F.least("u_head", "v_head").alias("u"), F.greatest("u_head", "v_head").alias("v"))
        same = same.unionByName(far)
    return same.where("u <> v")


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs with a similarity of 0.8 or more, 9 * both >= 4 * (one + other), from the texts themselves: they are shorter than
    the hashes of their sequences."""
    left, right = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("u", "a"), ("v", "b")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (v, a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3))):
                if v != last:  # rows of one v follow each other
                    last, one = v, shingles(b.as_py(), words)
                other = shingles(a.as_py(), words)
                keep[i] = 9 * len(np.intersect1d(one, other, assume_unique=True)) >= 4 * (len(one) + len(other))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["u", "v"])

    both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    return both.mapInArrow(each, "u long, v long")


def near_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, component_id) for every row with a doc_id: the smallest doc_id reachable over texts whose sets of word
    sequences have a Jaccard similarity of 0.8 or more. Blank and null texts are equal. An empty table gives an empty result."""
    rows = materialize(_sketches(docs, words))
    # equal sets are one node before anything meets, so a large group of copies is one row
    nodes = materialize(rows.groupBy("node").agg(F.min(F.struct("doc_id", "mark", "fp", "bands")).alias("x")).select("node", "x.*"))
    close = materialize(_close_prints(nodes))
    meet = _candidates(nodes).unionByName(close.select(F.col("u").alias("node"))).unionByName(close.select(F.col("v").alias("node"))).distinct()
    firsts = nodes.join(meet, "node", "left_semi").select("doc_id", "mark", "node")
    texts = materialize(_texts(docs).join(firsts.hint("shuffle_hash"), ["doc_id", "mark"]).select("node", "text").dropDuplicates(["node"]))
    members = materialize(_prefixes(texts, words))
    roots = materialize(texts.select("node", F.col("node").alias("root")))
    after, upto, pairs = 0, NEXT, close
    while True:
        known = members.join(roots, "node")
        found = materialize(_proposed(known, after, upto).unionByName(pairs).distinct())
        linked = materialize(_verified(found, texts, words))
        # only the roots that new links join are looked at; all other nodes keep theirs
        between = linked.join(roots.toDF("u", "a"), "u").join(roots.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        moved = star_components(between).toDF("root", "new_root")
        roots = materialize(roots.join(moved, "root", "left").select("node", F.coalesce("new_root", "root").alias("root")))
        open_ = members.join(roots, "node").groupBy("cell").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("place").alias("last")).where("a <> b")
        largest = open_.agg(F.max("last")).first()[0] or 0
        if upto >= largest:
            break
        after, upto, pairs = upto, upto * WIDER, close.limit(0)
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc_id")
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.select("node", "root").join(lowest, "root").select("node", "component_id")
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id stays, once; rows with a
    null doc_id all stay."""
    return first_of_each(docs, materialize(near_copies(docs)))
