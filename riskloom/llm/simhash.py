"""SimHash fingerprints and near-duplicate components by the generalised pigeonhole principle.

Two 64-bit fingerprints within ``threshold`` bits, cut into m parts with per-part thresholds t_i summing to
threshold - m + 1, agree on some part within t_i bits (t_i = -1: the part is not probed). Correlated bits share a part, so
that part values are unevenly spread, and each fingerprint gets its own thresholds by dynamic programming on the number of
candidates that the part-value histograms promise. Every fingerprint is indexed under all its part values and probes the
balls of its thresholds; the pairs that meet are verified on all 64 bits.

A part value shared by very many fingerprints is cut into chunks of members and chunks of probes, so that no task holds
more than one chunk pair, and a chunk pair gives only the spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import star_components
from .store import materialize

SEED = 42
SHINGLE_WORDS = 3
THRESHOLD = 3
#: Members or probes of a part value that meet in one task.
CHUNK = 4096
#: What enumerating and shuffling one probe costs, in verified candidates.
PROBE_COST = 8
#: Distinct fingerprints from which three wider parts are used instead of four.
WIDE_FROM = 1 << 26
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> bytes:
    """Big-endian 8 bytes; null, empty and blank texts give zero."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return bytes(8)
    digest = xxhash.xxh64_digest
    if len(tokens) < words:
        hashes = digest(b" ".join(tokens), SEED)
    else:
        hashes = b"".join([digest(b" ".join(s), SEED) for s in zip(*(tokens[i:] for i in range(words)))])
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), _BLOCK):
        counts += np.unpackbits(bits[at : at + _BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(bits)).tobytes()


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of unsigned 64-bit hashes as a signed number; of an empty set zero."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        counts += np.unpackbits(hashes[at : at + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), signed=True)


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = b"".join([fingerprint(t, words) for t in batch.column(1).to_pylist()])
            values = np.frombuffer(fps, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        each, "doc_id long, fp long"
    )


def _bits(fps: np.ndarray) -> np.ndarray:
    """n x 64, bit k of the unsigned value in column k."""
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the fingerprints differ; unsigned, as the count of a negative number is that of its size."""
    return np.bitwise_count((a ^ b).view(np.uint64))


@dataclass
class Parts:
    """Which bits make each part, with each part's histogram of values."""

    groups: list[list[int]]
    counts: list[np.ndarray]

    def values(self, fps: np.ndarray) -> list[np.ndarray]:
        return [part_values(fps, g) for g in self.groups]


def part_values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    unsigned, out = fps.view(np.uint64), np.zeros(len(fps), np.int64)
    for k, bit in enumerate(group):
        out |= ((unsigned >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def correlated_groups(together: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """64 bits in groups of near-equal width: each group grows from the strongest free pair by the bit with the largest
    mean absolute correlation to its members. together[i, j]: rows that have both bits set."""
    p = np.diag(together) / max(total, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs((together / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, -1.0)
    free, groups = list(range(64)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        sub = corr[np.ix_(free, free)]
        a, b = np.unravel_index(int(np.argmax(sub)), sub.shape)
        group = [free[a], free[b]] if a != b else [free[0], free[1]]
        while len(group) < width:
            rest = [x for x in free if x not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].mean(axis=1)))])
        groups.append(sorted(group))
        free = [x for x in free if x not in group]
    return groups


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits with at most ``radius`` set, fewest first."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def promised(counts: np.ndarray, width: int, radius: int) -> np.ndarray:
    """(radius + 2) x 2^width candidates of a probe with thresholds -1 .. radius."""
    out = np.zeros((radius + 2, len(counts)), np.float64)
    values, masks, done = np.arange(len(counts)), ball(width, radius), 0
    for r in range(radius + 1):
        ring = int(np.sum(np.bitwise_count(masks) <= r))
        out[r + 1] = out[r]
        for mask in masks[done:ring]:
            out[r + 1] += counts[values ^ mask]
        done = ring
    return out


def allocate(costs: list[np.ndarray], budget: int) -> np.ndarray:
    """costs[i]: (options x rows) for thresholds -1, 0, 1 ...; the thresholds (parts x rows) of least cost that sum to
    ``budget``, by dynamic programming over parts."""
    rows, lowest = costs[0].shape[1], -len(costs)
    states = range(lowest, max(budget, 0) + len(costs) + 1)
    best = {s: (np.zeros(rows) if s == 0 else np.full(rows, np.inf)) for s in states}
    choices = []
    for cost in costs:
        after, pick = {}, {}
        for s in states:
            value, chosen = np.full(rows, np.inf), np.full(rows, -1, np.int8)
            for option in range(len(cost)):
                before = best.get(s - (option - 1))
                if before is not None:
                    better = (total := before + cost[option]) < value
                    value, chosen = np.where(better, total, value), np.where(better, option - 1, chosen).astype(np.int8)
            after[s], pick[s] = value, chosen
        best = after
        choices.append(pick)
    out, state = np.zeros((len(costs), rows), np.int64), np.full(rows, budget, np.int64)
    for i in range(len(costs) - 1, -1, -1):
        table = np.stack([choices[i][s] for s in states])
        out[i] = table[state - lowest, np.arange(rows)]
        state = np.clip(state - out[i], lowest, states[-1])
    return out


def plan_parts(distinct: DataFrame, total: int, parts: int | None = None) -> Parts:
    """Bit correlations and part histograms over all distinct fingerprints; both have a fixed size (64 x 64 and at most
    2^22 counts a part), whatever the number of rows."""
    parts = parts or (4 if total < WIDE_FROM else 3)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((64, 64))
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), _BLOCK):
                b = _bits(fps[at : at + _BLOCK]).astype(np.float32)
                sums += b.T @ b
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i * 64 + j), pa.array(sums[i, j].astype(np.int64))], ["ij", "n"])

    together = np.zeros((64, 64))
    for ij, n in distinct.select("fp").mapInArrow(pairs, "ij long, n long").groupBy("ij").agg(F.sum("n")).collect():
        together[ij // 64, ij % 64] = n
    groups = correlated_groups(together, total, parts)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i, group in enumerate(groups):
                v, n = np.unique(part_values(fps, group), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), i, np.int64)), pa.array(v), pa.array(n.astype(np.int64))], ["i", "v", "n"]
                )

    counts = [np.zeros(1 << len(g), np.int64) for g in groups]
    found = distinct.select("fp").mapInArrow(histogram, "i long, v long, n long").groupBy("i", "v").agg(F.sum("n").alias("n"))
    for i, v, n in found.toLocalIterator():
        counts[i][v] = n
    return Parts(groups, counts)


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated counts times, and the running number within each."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def meetings(distinct: DataFrame, parts: Parts, threshold: int, chunk: int = CHUNK, radius: int = 2) -> DataFrame:
    """(cell, probe, fp): members and probes by the cell in which they meet."""
    budget, groups = threshold - len(parts.groups) + 1, parts.groups
    radius = max(radius, -(-budget // len(groups)))
    tables, splits = [], []
    for group, counts in zip(groups, parts.counts):
        seen = promised(counts, len(group), radius)
        sizes = np.array([0, *(np.cumsum([1 if r == 0 else len(ball(len(group), r)) - len(ball(len(group), r - 1)) for r in range(radius + 1)]))])
        tables.append((seen + PROBE_COST * sizes[:, None]).astype(np.float32))
        splits.append((np.maximum(1, -(-counts // chunk)).astype(np.int32), np.maximum(1, np.ceil(seen[2] / chunk)).astype(np.int32)))
    balls = [[ball(len(g), r) for r in range(radius + 1)] for g in groups]

    def cells(i: int, v: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (np.int64(i) << 62) ^ (v << 40) ^ (m.astype(np.int64) << 20) ^ p.astype(np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(cell: np.ndarray, probe: bool, fps: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(cell), probe)), pa.array(fps)], ["cell", "probe", "fp"])

        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 8192):
                fps = every[at : at + 8192]
                salt = (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                values = [part_values(fps, g) for g in groups]
                thresholds = allocate([t[:, v] for t, v in zip(tables, values)], budget)
                for i, v in enumerate(values):
                    in_members, in_probes = splits[i]
                    at_row, p = _expand(in_probes[v])
                    own = v[at_row]
                    yield rows(cells(i, own, salt[at_row] % in_members[own], p), False, fps[at_row])
                    for r in range(radius + 1):
                        if len(who := np.nonzero(thresholds[i] == r)[0]):
                            near = (v[who][:, None] ^ balls[i][r][None, :]).ravel()
                            source = np.repeat(who, len(balls[i][r]))
                            keep = parts_seen[i][near]
                            near, source = near[keep], source[keep]
                            at_row, m = _expand(in_members[near])
                            near, source = near[at_row], source[at_row]
                            yield rows(cells(i, near, m, salt[source] % in_probes[near]), True, fps[source])

    parts_seen = [c > 0 for c in parts.counts]
    return distinct.select("fp").mapInArrow(each, "cell long, probe boolean, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node reached) that connect what the pairs connect."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def verified_links(met: DataFrame, threshold: int) -> DataFrame:
    """(u, v): spanning forests of the links that each run of cells holds. Rows of a cell arrive together."""

    def links(cell: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.nonzero(np.r_[True, cell[1:] != cell[:-1]])[0]
        ends = np.r_[starts[1:], len(cell)]
        cum = np.r_[0, np.cumsum(probe)]
        probes = cum[ends] - cum[starts]
        members = ends - starts - probes
        useful = (probes > 0) & (members > 0)
        starts, probes, members = starts[useful], probes[useful], members[useful]
        found_a, found_b, size = [], [], 0
        pairs = probes * members
        at = 0
        while at < len(starts):
            till = max(at + 1, int(np.searchsorted(np.cumsum(pairs[at:]), 2_000_000, "right")) + at)
            if till == at + 1:  # one cell, in slices of its members
                s, m, n = starts[at], members[at], probes[at]
                own, others = fp[s : s + m], fp[s + m : s + m + n]
                step = max(1, 2_000_000 // n)
                for k in range(0, m, step):
                    i, j = np.nonzero(differing(own[k : k + step, None], others[None, :]) <= threshold)
                    a, b = own[k + i], others[j]
                    if (keep := a != b).any():
                        a, b = _forest(a[keep], b[keep])
                        found_a.append(a)
                        found_b.append(b)
            else:
                rows, k = _expand(pairs[at:till])
                s, m, n = starts[at:till][rows], members[at:till][rows], probes[at:till][rows]
                a, b = fp[s + k // n], fp[s + m + k % n]
                keep = (differing(a, b) <= threshold) & (a != b)
                if keep.any():
                    found_a.append(a[keep])
                    found_b.append(b[keep])
            at = till
        if found_a:
            yield _forest(np.concatenate(found_a), np.concatenate(found_b))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if rest is not None:
                now = [np.concatenate([x, y]) for x, y in zip(rest, now)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last cell may go on
            rest = [x[cut:] for x in now]
            for u, v in links(*[x[:cut] for x in now]) if cut else ():
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if rest is not None and len(rest[0]):
            for u, v in links(*rest):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    ordered = met.repartition("cell").sortWithinPartitions("cell", "probe")
    return ordered.mapInArrow(each, "u long, v long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, words: int = SHINGLE_WORDS, parts: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; other columns take no part.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable over fingerprints that differ in at
    most ``threshold`` bits. Equal fingerprints are one node, so copies cost nothing. Null or blank texts have fingerprint
    zero and link like any other; a null doc_id keeps its row and never names a component unless it is alone. Repeated
    rows stay repeated. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, words))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    total = distinct.count()
    met = meetings(distinct, plan_parts(distinct, total, parts), threshold) if total else None
    if met is None:
        named = distinct.select("fp", F.col("first_doc").alias("component_id"))
    else:
        roots = star_components(verified_links(met, threshold)).withColumnRenamed("node", "fp")
        rooted = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_doc")
        lowest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
        named = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id stays, once.

    All columns of ``docs`` are kept. Rows repeated with one doc_id count as copies, of which one stays; rows with a null
    doc_id cannot be told apart and all stay.
    """
    return first_of_each(docs, materialize(near_duplicates(docs, threshold, words).select("doc_id", "component_id")))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its component in ``found`` (doc_id, component_id), once, and those without one."""
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    # the kept ids grow with the documents, so they are never broadcast; hashing them spares sorting the texts
    named = docs.where("doc_id is not null").join(kept.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    if not kept.where("n > 1").isEmpty():  # repeated rows: one of each stays
        named = named.dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))
