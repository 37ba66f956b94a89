"""N-gram Jaccard join: token-combination prefixes, then verification of whole sets.

A text is the set of its distinct five-word sequences (tokens). Equal sets are one node. A set of n tokens may miss E = n - ceil(0.8 n) of
them in a partner, so most texts fall out at once: more than E of those of their tokens that have a low value are in no other set. How
many are is counted exactly, or too low where two tokens share a value, over packed ranges of values; none is counted too high.

The tokens of the others are ordered by how many sets hold them, rarest first. The j-th token that two similar sets share is among the
first E + j of each. If the first one is rare, it is among the first E + 1, and single tokens are indexed there. If it is
frequent, all shared ones are, and the first J of them lie in prefixes extended to E + J; between two of them that follow each
other both sets together have a gap of at most 2 + (E + E') / (J - 1). So combinations of two frequent tokens that lie so near are indexed, a
number in proportion to the set's size, in place of the long lists of frequent tokens.

Members of an index cell that can be similar by their sizes and by what is left of both sets are proposed: first those next to each other in a
few cells of each set, then those next to each other in all, those some places on, and chunks of a cell against chunks, each time without
pairs that links have joined or that were compared already. After the first, rows have a sketch of each set, whether an odd number of its
tokens falls on each of some bits: the bits in which two sketches differ are at most the tokens that only one set has, so a pair with too many
is in no need of its texts. They also have the set's first cells and its place in each, so that of all cells that both sets of a pair are in
the first one proposes it, where it is proposed in the same round, and the others do not.
Whole texts decide. A cell's chunks meet in tasks of their own, and rows of one size and place are ruled out as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import star_components
from .store import materialize

WORDS, PERCENT = 5, 80
SEED = 42
#: Sets that hold a token, up to which it is rare.
RARE = 64
#: Prefixes are extended by one token in so many of the set.
EXTEND = 10
#: Rows of a cell that follow in the first two rounds; rows of a chunk in the last.
NEAR, CHUNK = (2, 32), 1024
#: Cells of a set that are looked at before all others; pairs that a task holds before it sends them on.
ANCHORS, PAIRS = 4, 1_000_000
#: Tokens and sets that a task holds before it packs them, and about how many a range of token values has.
HELD, HELD_SETS, RANGE = 4_000_000, 60_000, 2_000_000
#: Bits of a token's value within its range, as long as there are fewer than 2^20 ranges.
BITS = 28
#: Values below LOW / 16 of all are counted to find candidates, all tokens of which are looked at then.
LOW = 8
#: A sketch has the power of two of bits that follows SKETCH times the set's size, within these powers.
SKETCH, SKETCH_BITS = 2.0, (6, 13)
#: Bitmaps that say which texts may be candidates, and the bits of one.
BITMAPS, BITMAP = 2048, 32768
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20

_FACTOR, _TURN, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(29), np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTES = np.random.default_rng(SEED).integers(1, np.iinfo(np.uint64).max, 256, np.uint64)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]


def _mixed(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = (state ^ value) * _FACTOR
    return out ^ (out >> _TURN)


class _Powers:
    """Powers of the factor and of its inverse modulo 2^64, as many as were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(2 * n, x, np.uint64)]) for x in (_STEP, np.uint64(pow(int(_STEP), -1, 1 << 64))))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word: what its bytes add to a running polynomial, taken back to the word's start. A-Z count as a-z."""
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not _BLANK[text[end]]:  # a piece ends between words
            end += 1
        piece = np.frombuffer(text, np.uint8)[at:end]
        inside = np.zeros(len(piece) + 2, np.int8)
        inside[1:-1] = ~_BLANK[piece]
        turns = np.diff(inside)
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        up, down = _POWERS.upto(len(piece))
        running = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTES[piece] * up, out=running[1:])
        out.append(_mixed((running[ends] - running[starts]) * down[starts], (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def tokens(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word sequences of UTF-8 text, only A-Z lower-cased; fewer words are one sequence, none give none."""
    own = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(own):
        return own
    many, length = max(len(own) - words + 1, 1), min(len(own), words)
    state = np.full(many, length, np.uint64)
    for j in range(length):
        state = _mixed(state, own[j : j + many])
    state.sort()
    return state[np.r_[True, state[1:] != state[:-1]]]


def misses(n, percent: int = PERCENT):
    """How many of a set's n tokens may be missing in a similar one."""
    return n - -(-n * percent // 100)


def extension(n):
    """How many shared tokens the extended prefix holds."""
    return np.maximum(2, n // EXTEND)


def reach(n: int, percent: int = PERCENT) -> int:
    """The widest gap of a combination in a set of n tokens, whatever the size of a similar set."""
    least, most = -(-n * percent // 100), n * 100 // percent
    return 1 + int((misses(n, percent) + misses(most, percent)) // max(int(extension(least)) - 1, 1))


def signatures(n: int, spread: np.ndarray, own: np.ndarray, percent: int = PERCENT, rare: int = RARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, before, left) of a set of n tokens: ``own`` are those of other sets too, by ``spread`` (how many sets), rarest first.
    What two members of a cell share is at most the lesser ``before`` + 1 + the lesser ``left``, unless another cell has both."""
    place, e = n - len(own) + np.arange(len(own)), int(misses(n, percent))
    single = np.nonzero((spread <= rare) & (place <= e))[0]
    often = np.nonzero((spread > rare) & (place < e + int(extension(n))))[0]
    cells, before, left = [_mixed(np.uint64(1), own[single])], [np.zeros(len(single), np.int64)], [n - place[single] - 1]
    for gap in range(1, min(reach(n, percent), len(often) - 1) + 1):
        one, two = often[:-gap], often[gap:]
        cells.append(_mixed(_mixed(np.uint64(2), own[one]), own[two]))
        before.append(one - often[0] + 1)
        left.append(n - place[two] - 1)
    cells, before, left = np.concatenate(cells), np.concatenate(before), np.concatenate(left)
    # a partner has ceil(n * percent / 100) tokens or more: a cell after which too few are left to share with it is in no possible pair
    open_ = (100 + percent) * (before + 1 + left) >= percent * (n + -(-n * percent // 100))
    return cells[open_], before[open_], left[open_]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(doc_id, mark, node, n, low): the hash of each text's set, its size and how many of its tokens have a low value."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, low = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(2)):
                own = tokens(text.as_py(), words)
                nodes[i], sizes[i], low[i] = _node(own), len(own), _low(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (nodes, sizes, low))], ["doc_id", "mark", "node", "n", "low"])

    return texts.mapInArrow(each, "doc_id long, mark long, node long, n long, low long")


def _low(own: np.ndarray) -> int:
    """How many of the sorted tokens have a low value."""
    return len(own) if LOW >= 16 else int(np.searchsorted(own, np.uint64(LOW << 60)))


def _node(own: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(own.tobytes(), SEED), signed=True)


def _packed(texts: DataFrame, words: int, bits: int) -> DataFrame:
    """(bucket, nodes, who, value, wide): for each of 2^bits ranges of token values that has low ones, the sets of a task that have tokens
    in it, whose each token is, and the steps from value to value."""
    within = min(BITS, 48 - bits)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = {}, ["bucket", "nodes", "who", "value", "wide"]

        def drained() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            nodes, sizes = np.fromiter(held, np.int64, len(held)), [len(x) for x in held.values()]
            # a token's value and whose it is in one number, which sorts much faster than rows
            rows = np.concatenate(list(held.values())) >> np.uint64(64 - bits - within) << np.uint64(16)
            held.clear()
            rows |= np.repeat(np.arange(len(nodes), dtype=np.uint64), sizes)
            rows.sort()
            cuts = np.searchsorted(rows >> np.uint64(within + 16), np.arange((1 << bits) + 1, dtype=np.uint64))
            for bucket in np.nonzero(np.diff(cuts))[0]:
                part = rows[cuts[bucket] : cuts[bucket + 1]]
                who, value = (part & np.uint64(0xFFFF)).astype(np.int64), (part >> np.uint64(16) & np.uint64((1 << within) - 1)).astype(np.int64)
                met = np.zeros(len(nodes), bool)
                met[who] = True
                steps = np.diff(value, prepend=0)
                wide = bool(steps.max() >= 1 << 16)
                row = [int(bucket), nodes[met].astype("<i8").tobytes(), (np.cumsum(met) - 1)[who].astype("<u2").tobytes(), steps.astype("<u4" if wide else "<u2").tobytes(), wide]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

        size = 0
        for batch in batches:
            for text in batch.column(2):
                own = tokens(text.as_py(), words)
                if len(own) < 2 or (node := _node(own)) in held:
                    continue
                held[node] = own[: _low(own)].copy()
                size += len(held[node])
                if size > HELD or len(held) > HELD_SETS:
                    yield from drained()
                    size = 0
        yield from drained()

    return texts.mapInArrow(each, "bucket long, nodes binary, who binary, value binary, wide boolean")


def _common(packed: DataFrame) -> DataFrame:
    """(node, m): how many packed tokens of each set are in another set too; values that tokens share make it larger, never smaller."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list) -> pa.RecordBatch:
            names, place = np.unique(np.concatenate([nodes for _, nodes, _ in parts]), return_inverse=True)
            starts = np.cumsum([0, *(len(nodes) for _, nodes, _ in parts)])
            who = np.concatenate([place[start + own] for start, (_, _, own) in zip(starts, parts)]).astype(np.uint64)
            width = np.uint64(max(len(names) - 1, 1).bit_length())
            rows = np.concatenate([value for value, _, _ in parts]).astype(np.uint64) << width | who
            rows.sort()
            rows = rows[np.r_[True, rows[1:] != rows[:-1]]]  # a set that several tasks met counts once
            value = rows >> width
            same = value[1:] == value[:-1]
            m = np.bincount((rows[np.r_[False, same] | np.r_[same, False]] & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64), minlength=len(names))
            return pa.RecordBatch.from_arrays([pa.array(names[m > 0]), pa.array(m[m > 0].astype(np.int64))], ["node", "m"])

        last, parts = None, []
        for batch in batches:
            for bucket, nodes, who, value, wide in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != last and parts:
                    yield counted(parts)
                    parts = []
                last = bucket
                steps = np.frombuffer(value, "<u4" if wide else "<u2").astype(np.int64)
                parts.append((np.cumsum(steps), np.frombuffer(nodes, "<i8"), np.frombuffer(who, "<u2").astype(np.int64)))
        if parts:
            yield counted(parts)

    ranges = packed.repartition("bucket").sortWithinPartitions("bucket")
    return ranges.mapInArrow(each, "node long, m long").groupBy("node").agg(F.sum("m").alias("m"))


def _ranges(texts: DataFrame, words: int, bits: int) -> DataFrame:
    """(bucket, node, n, sizes, token), the last four packed: the sets of a task, and how many and which tokens each has in the range."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []

        def drained() -> Iterator[pa.RecordBatch]:
            nodes, n = np.array([x for x, _ in held], "<i8"), np.array([len(x) for _, x in held], "<i8")
            edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
            cuts = np.array([[0, *np.searchsorted(own, edges), len(own)] for _, own in held])
            for bucket in range(1 << bits):
                sizes = (cuts[:, bucket + 1] - cuts[:, bucket]).astype("<i4")
                its = np.concatenate([own[x:y] for (_, own), x, y in zip(held, cuts[:, bucket], cuts[:, bucket + 1])])
                some = sizes > 0
                if len(its):
                    row = [bucket, *(x.tobytes() for x in (nodes[some], n[some], sizes[some], its.astype("<u8")))]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["bucket", "node", "n", "sizes", "token"])
            held.clear()

        size = 0
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((node, tokens(text.as_py(), words)))
                size += len(held[-1][1])
                if size > HELD or len(held) > HELD_SETS:
                    yield from drained()
                    size = 0
        if held:
            yield from drained()

    return texts.select("node", "text").mapInArrow(each, "bucket long, node binary, n binary, sizes binary, token binary")


def _shared(ranges: DataFrame) -> DataFrame:
    """(node, n, spread, token): the tokens, packed, of each set in a range that other sets have too, and how many sets have them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list) -> Iterator[pa.RecordBatch]:
            nodes, n, sizes, token = map(np.concatenate, zip(*parts))
            order = np.argsort(token)
            new = np.r_[True, token[order[1:]] != token[order[:-1]]]
            spread = np.empty(len(token), np.int32)
            spread[order] = np.repeat(np.diff(np.r_[np.flatnonzero(new), len(token)]), np.diff(np.r_[np.flatnonzero(new), len(token)]))
            ends = np.cumsum(sizes, dtype=np.int64)
            for at in range(0, len(nodes), 1024):
                rows = []
                for k in range(at, min(at + 1024, len(nodes))):
                    its = spread[ends[k] - sizes[k] : ends[k]]
                    if len(kept := np.flatnonzero(its > 1)):
                        rows.append((int(nodes[k]), int(n[k]), its[kept].tobytes(), token[ends[k] - sizes[k] : ends[k]][kept].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["node", "n", "spread", "token"])

        last, parts = None, []
        for batch in batches:
            for bucket, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != last and parts:
                    yield from counted(parts)
                    parts = []
                last = bucket
                parts.append([np.frombuffer(x, kind) for x, kind in zip(packed, ("<i8", "<i8", "<i4", "<u8"))])
        if parts:
            yield from counted(parts)

    return ranges.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(each, "node long, n long, spread binary, token binary")


def _members(texts: DataFrame, words: int, percent: int, rare: int) -> DataFrame:
    """(cell, place, node, n, before, left, anchor): index cells of two members or more; place runs through a cell by size. anchor: the cell is
    one of the set's few with the smallest hashes, which similar sets often share. texts: (node, n, text)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spread, own = (np.frombuffer(b"".join(x[name] for x in items), kind) for name, kind in (("spread", "<i4"), ("token", "<u8")))
                order = np.lexsort((own, spread))
                cells, before, left = signatures(n, spread[order], own[order], percent, rare)
                size = len(cells)
                anchor = np.zeros(size, bool)
                anchor[np.argsort(cells)[:ANCHORS]] = True
                columns = [cells.view(np.int64), np.full(size, node, np.int64), np.full(size, n, np.int64), before, left, anchor]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["cell", "node", "n", "before", "left", "anchor"])

    bits = max(4, ceil(log2(max(texts.agg(F.sum("n")).first()[0] or 0, 1) / RANGE)))
    lists = _shared(_ranges(texts, words, bits)).groupBy("node", "n").agg(F.collect_list(F.struct("spread", "token")).alias("own"))
    cells = lists.mapInArrow(signed, "cell long, node long, n long, before long, left long, anchor boolean")
    ordered = cells.repartition("cell").sortWithinPartitions("cell", "n", "node")
    return ordered.mapInArrow(_placed, "cell long, place long, node long, n long, before long, left long, anchor boolean")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, numbered within their cell; cells of one row go."""
    last, at, rest = None, 0, None
    names = ["cell", "place", "node", "n", "before", "left", "anchor"]

    def out(now: list[np.ndarray], following: int | None) -> pa.RecordBatch:
        nonlocal last, at
        cell = now[0]
        new = np.r_[last is None or cell[0] != last, cell[1:] != cell[:-1]]
        ends = np.r_[new[1:], following is None or following != cell[-1]]
        starts = np.nonzero(np.r_[True, new[1:]])[0]
        place = np.arange(len(cell)) - np.repeat(starts, np.diff(np.r_[starts, len(cell)]))
        if not new[0]:
            place[: starts[1] if len(starts) > 1 else len(cell)] += at
        last, at = cell[-1], int(place[-1]) + 1
        keep = ~(new & ends)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (cell, place, *now[1:])], names)

    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            now = [np.concatenate([x, y]) for x, y in zip(rest, now)]
        if len(now[0]):
            rest = [x[-1:] for x in now]  # whether it stands alone is known with the next row
            if len(now[0]) > 1:
                yield out([x[:-1] for x in now], now[0][-1])
    if rest is not None:
        yield out(rest, None)


def possible(n: np.ndarray, before: np.ndarray, left: np.ndarray, m: np.ndarray, before_m: np.ndarray, left_m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of n and m tokens can be similar, by what they can share."""
    most = np.minimum(np.minimum(before, before_m) + 1 + np.minimum(left, left_m), np.minimum(n, m))
    return (100 + percent) * most >= percent * (n + m)


def sketch(own: np.ndarray) -> bytes:
    """For each bit whether an odd number of tokens falls on it."""
    bits = 1 << max(SKETCH_BITS[0], min(SKETCH_BITS[1], ceil(log2(max(SKETCH * len(own), 1)))))
    counts = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


class _Sketches:
    """Sketches of rows. Those of pairs of which one is twice as long are compared once its halves are laid over each other."""

    def __init__(self, items: np.ndarray) -> None:
        self.items, self.bytes = items, np.fromiter(map(len, items), np.int64, len(items))
        self.laid: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length not in self.laid:
            place, words, at = np.zeros(len(self.items), np.int64), [], 0
            for many in (1, 2):
                rows = np.flatnonzero(self.bytes == many * length)
                bits = np.frombuffer(b"".join(self.items[rows]), "<u8").reshape(len(rows), many, length // 8)
                words.append(np.bitwise_xor.reduce(bits, axis=1))
                place[rows], at = at + np.arange(len(rows)), at + len(rows)
            self.laid[length] = place, np.concatenate(words)
        return self.laid[length]

    def fit(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        """Whether rows i and j, whose sizes are possible, do not differ in more bits than similar sets of their sizes have tokens apart."""
        sizes, out = n[i] + n[j], np.ones(len(i), bool)
        apart = sizes - 2 * -(-percent * sizes // (100 + percent))
        shorter = np.minimum(self.bytes[i], self.bytes[j])
        alike = np.maximum(self.bytes[i], self.bytes[j]) <= 2 * shorter
        for length in np.unique(shorter):
            place, words = self._of(int(length))
            rows = np.flatnonzero((shorter == length) & alike)
            for at in range(0, len(rows), 1 << 15):
                k = rows[at : at + (1 << 15)]
                out[k] = np.bitwise_count(words[place[i[k]]] ^ words[place[j[k]]]).sum(axis=1, dtype=np.int64) <= apart[k]
        return out


def _sketches(texts: DataFrame, words: int) -> DataFrame:
    """(node, sketch) of (node, n, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([sketch(tokens(x.as_py(), words)) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["node", "sketch"])

    return texts.select("node", "text").mapInArrow(each, "node long, sketch binary")


def _marks(texts: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(node, sketch, firsts): firsts are cell, place, before and left of each anchor, one after the other."""
    own = F.collect_list(F.array("cell", "place", "before", "left"))
    firsts = members.where("anchor").groupBy("node").agg(F.flatten(own).alias("firsts"))
    none = F.array().cast("array<long>")
    return _sketches(texts, words).join(firsts, "node", "left").select("node", "sketch", F.coalesce("firsts", none).alias("firsts"))


class _Firsts:
    """The first cells of rows, and place, before and left in each."""

    def __init__(self, items: np.ndarray) -> None:
        sizes = np.fromiter(map(len, items), np.int64, len(items)) // 4
        slot = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.sizes, self.held = sizes, np.zeros((max(sizes, default=0), len(items), 4), np.int64)
        self.held[slot, np.repeat(np.arange(len(items)), sizes)] = np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64).reshape(-1, 4)

    def again(self, i: np.ndarray, j: np.ndarray, cell: np.ndarray, n: np.ndarray, percent: int, after: int = -1, upto: int | None = None) -> np.ndarray:
        """Whether rows i and j of a cell are also in a lower one, where they are possible and lie more than ``after`` and at most ``upto``
        places apart: that one proposes them."""
        out, own = np.zeros(len(i), bool), cell.view(np.uint64)[i]
        for a, one in enumerate(self.held):
            for b, two in enumerate(self.held):
                of = one[i, 0]
                k = np.flatnonzero((of == two[j, 0]) & (of.view(np.uint64) < own) & (self.sizes[i] > a) & (self.sizes[j] > b) & ~out)
                x, y = one[i[k]], two[j[k]]
                apart = np.abs(x[:, 1] - y[:, 1])
                near = (apart > after) & (apart <= (apart if upto is None else upto))
                out[k] = near & possible(n[i[k]], x[:, 2], x[:, 3], n[j[k]], y[:, 2], y[:, 3], percent)
        return out


def _neighbours(known: DataFrame, after: int, upto: int, percent: int) -> DataFrame:
    """(u, v): possible pairs of different roots that lie more than ``after`` and at most ``upto`` places apart in a cell. A task holds
    the last ``upto`` rows. known: members with root, and with sketch and firsts or without."""
    columns = ["cell", "node", "n", "before", "left", "root", *(c for c in ("sketch", "firsts") if c in known.columns)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = None, []
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            old = 0 if kept is None else len(kept[0])
            if kept is not None:
                now = [np.concatenate([x, y]) for x, y in zip(kept, now)]
            cell, node, n, before, left, root = now[:6]
            marks = _Sketches(now[6]) if len(now) > 6 else None
            firsts = _Firsts(now[7]) if len(now) > 7 else None
            for d in range(after + 1, min(upto, len(cell) - 1) + 1):
                first = max(0, old - d)  # pairs of two old rows are done
                i = np.arange(first, len(cell) - d)
                i = i[(cell[i] == cell[i + d]) & (root[i] != root[i + d])]
                i = i[possible(n[i], before[i], left[i], n[i + d], before[i + d], left[i + d], percent)]
                if marks is not None:
                    i = i[marks.fit(i, i + d, n, percent)]
                if firsts is not None:
                    i = i[~firsts.again(i, i + d, cell, n, percent, after, upto)]
                if len(i):
                    held.append(_pairs(node[i], node[i + d]))
            kept = [x[-upto:] for x in now]
            if sum(map(len, held)) > PAIRS:
                yield _sent(held)
        if held:
            yield _sent(held)

    ordered = known.repartition("cell").sortWithinPartitions("cell", "place").select(*columns)
    return ordered.mapInArrow(each, "u long, v long")


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.column_stack([np.minimum(a, b), np.maximum(a, b)])


def _sent(held: list[np.ndarray]) -> pa.RecordBatch:
    """Each pair once; what was held is empty then."""
    both = np.concatenate(held)
    held.clear()
    both = both[np.lexsort((both[:, 0], both[:, 1]))]
    both = both[np.r_[True, (both[1:] != both[:-1]).any(axis=1)]]
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["u", "v"])


def _chunk_pairs(known: DataFrame, last: DataFrame, percent: int, chunk: int) -> DataFrame:
    """(u, v): all possible pairs of different roots in cells. last (cell, lowest): the cells that are looked at and their lowest root. Each
    two chunks of a cell, not both of its lowest root, are a task's group, which holds no more than them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(rows: list[np.ndarray]) -> Iterator[np.ndarray]:
            side, same = rows[3], rows[1][0] == rows[2][0]
            one = np.nonzero(side == rows[1])[0]
            two = one if same else np.nonzero(side == rows[2])[0]
            if not len(one) or not len(two):
                return
            node, n, before, left, root = rows[4:9]
            (a, of_a), (b, of_b) = (_kinds(n[x], before[x], left[x]) for x in (one, two))
            fits = possible(*(x[a][:, None] for x in (n[one], before[one], left[one])), *(x[b][None, :] for x in (n[two], before[two], left[two])), percent)
            if not fits.any():
                return
            x, y = np.nonzero(fits[of_a][:, of_b] & (root[one][:, None] != root[two][None, :]))
            i, j = one[x], two[y]
            if same:
                i, j = i[x < y], j[x < y]
            if len(rows) > 9 and len(i):
                fit = _Sketches(rows[9]).fit(i, j, n, percent)
                i, j = i[fit], j[fit]
            if len(rows) > 10 and len(i):
                new = ~_Firsts(rows[10]).again(i, j, rows[0], n, percent)
                i, j = i[new], j[new]
            if len(i):
                yield _pairs(node[i], node[j])

        rest, held = None, []
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                now = [np.concatenate([x, y]) for x, y in zip(rest, now)]
            if not len(now[0]):
                continue
            cuts = np.nonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1]))[0] + 1
            for start, end in zip(np.r_[0, cuts][:-1], cuts):
                for pairs in met([x[start:end] for x in now]):
                    held.append(pairs)
                    if sum(map(len, held)) > PAIRS:
                        yield _sent(held)
            rest = [x[cuts[-1] if len(cuts) else 0 :] for x in now]
        held += [] if rest is None else met(rest)
        if held:
            yield _sent(held)

    return _dealt(known, last, percent, chunk).repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b").mapInArrow(each, "u long, v long")


def _kinds(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each kind that the columns make, and each row's kind."""
    key = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        values, place = np.unique(column, return_inverse=True)
        key = np.unique(key * len(values) + place, return_inverse=True)[1]
    return np.unique(key, return_index=True)[1], key


def _dealt(known: DataFrame, last: DataFrame, percent: int, chunk: int) -> DataFrame:
    """(cell, a, b, own, node, n, before, left, root, sketch and firsts where known has them): each row as often as its chunk meets another; chunks of the lowest root count down from -1."""
    # members of a cell's lowest root, mostly those of its largest component, need not meet each other
    rows = known.join(last.select("cell", "lowest"), "cell").withColumn("home", F.col("root") == F.col("lowest"))
    away = lambda x: F.when(~F.col("home"), F.col(x))
    ends = [f(x(c)).alias(f"{name}_{c}_{f.__name__}") for name, x in (("away", away), ("every", F.col)) for c, f in (("n", F.min), ("n", F.max), ("before", F.max), ("left", F.max))]
    size = rows.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("aways"), *ends)
    rows = rows.join(size, "cell").where(F.when(F.col("home"), _meets("away", percent)).otherwise(_meets("every", percent)))
    place = F.row_number().over(Window.partitionBy("cell", "home").orderBy("n", "node")) - 1
    own = F.floor(place / chunk)
    chunks = lambda x: F.floor((F.col(x) + chunk - 1) / chunk)
    rows = rows.withColumn("own", F.when(F.col("home"), -1 - own).otherwise(own))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("home"), F.lit(0)).otherwise(-chunks("homes")), chunks("aways") - 1)))
    return rows.select("cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "n", "before", "left", "root", *(c for c in ("sketch", "firsts") if c in known.columns))


def _meets(whom: str, percent: int) -> Column:
    """Whether a row can be similar to one of ``whom``, by the least and the most that they have."""
    n, fewest = F.col("n"), F.greatest(F.col(f"{whom}_n_min"), F.ceil(F.col("n") * percent / 100))
    most = F.least(F.least("before", f"{whom}_before_max") + 1 + F.least("left", f"{whom}_left_max"), n)
    return (fewest <= F.col(f"{whom}_n_max")) & ((100 + percent) * most >= percent * (n + fewest))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar. A text v comes once, followed by the texts u that are compared with it."""
    other = pairs.join(texts, pairs["u"] == texts["node"]).select("v", "u", "text")
    own = texts.join(pairs.select("v").distinct(), texts["node"] == F.col("v"), "left_semi").select(F.col("node").alias("v"), F.lit(None).cast("long").alias("u"), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = None
        for batch in batches:
            us, vs, keep = batch.column(1).to_pylist(), batch.column(0), np.zeros(batch.num_rows, bool)
            for i, text in enumerate(batch.column(2)):
                left = tokens(text.as_py(), words)
                if us[i] is None:
                    right = left
                    continue
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(left) + len(right) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(mask), vs.filter(mask)], ["u", "v"])

    every = own.unionByName(other).repartition("v").sortWithinPartitions("v", F.col("u").asc_nulls_first())
    return every.mapInArrow(each, "u long, v long")


def _roots(roots: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, root) after the links: only roots that they join change."""
    between = linked.join(roots.toDF("u", "a"), "u").join(roots.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    moved = star_components(between).toDF("root", "new_root")
    return materialize(roots.join(moved, "root", "left").select("node", F.coalesce("new_root", "root").alias("root")))


def _slot() -> tuple[Column, Column]:
    """The bitmap and the bit in it that a row's doc_id and mark fall on."""
    slot = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(BITMAPS * BITMAP))
    return F.floor(slot / BITMAP).cast("int"), F.pmod(slot, F.lit(BITMAP))


def _maybe(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``texts`` that can be among ``chosen`` (doc_id, mark): all that are, and few others while chosen are fewer than bits. What
    follows need not shuffle the rest. The bits, BITMAPS times BITMAP at any size, are broadcast."""
    which, bit = _slot()
    bitmaps = chosen.groupBy(which.alias("which")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = texts.withColumn("which", which).join(F.broadcast(bitmaps), "which")
    return rows.where((F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1)).select(texts.columns)


def candidates(texts: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, n, text), once each: sets of whose low tokens not more are in no other set than may be missing in a partner."""
    nodes = sets.where("n > 1").groupBy("node", "n", "low").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    bits = max(4, ceil(log2(max(total, 1) / RANGE)))
    alone = F.col("low") - F.coalesce("m", F.lit(0))
    enough = nodes.join(_common(_packed(texts, words, bits)), "node", "left").where(100 * alone <= (100 - percent) * F.col("n"))
    chosen = materialize(enough.select("node", "n", F.col("first.doc_id").alias("own_id"), F.col("first.mark").alias("own_mark")))
    some = _maybe(texts, chosen.select(F.col("own_id").alias("doc_id"), F.col("own_mark").alias("mark")))
    # one key of 64 bits, as texts and sets have: rows that are repeated are where the join brings them, no second shuffle of texts finds them
    met = some.withColumn("key", F.xxhash64("doc_id", "mark")).join(chosen.withColumn("key", F.xxhash64("own_id", "own_mark")), "key")
    return met.select("key", "node", "n", "text").dropDuplicates(["key", "node"]).drop("key")


def similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rare: int = RARE, near: tuple[int, ...] = NEAR, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; other columns take no part.

    n_shingles: how many distinct sequences of ``words`` words the text has (fewer words: one sequence, the whole). component_id: the
    smallest doc_id reachable over texts of whose sequences at least ``percent`` (over 50) in a hundred are common to both. Null, empty and
    blank texts have none and reach only themselves. Rows with a null doc_id keep their row and link like others, but name no
    component: theirs is null where nothing else is reached. Repeated rows stay repeated. An empty table gives an empty result.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must lie above 50, up to 100")
    spark, texts = docs.sparkSession, _texts(docs)
    sets = materialize(_sets(texts, words))
    some = materialize(candidates(texts, sets, words, percent))
    members = materialize(_members(some, words, percent, rare))
    roots = materialize(some.select("node", F.col("node").alias("root")))
    tested = spark.createDataFrame([], "u long, v long")
    marks = materialize(_marks(some, members, words))
    for part, after, upto in ((F.col("anchor"), 0, 1), *((F.lit(True), a, b) for a, b in zip((0, *near), (*near, None)))):
        known = members.where(part).join(roots, "node")
        open_ = known.groupBy("cell").agg(F.min("root").alias("lowest"), F.max("root").alias("b"), F.max("place").alias("last")).where("lowest <> b")
        cells = materialize(open_.where(F.col("last") > after).select("cell", "lowest"))
        if cells.isEmpty():
            continue
        left = known.join(cells.select("cell"), "cell", "left_semi")
        if after or upto != 1:  # cells that are closed stay so
            left = materialize(left)
            members, left = left.drop("root"), left.join(marks, "node")
        found = _neighbours(left, after, upto, percent) if upto else _chunk_pairs(left, cells, percent, chunk)
        found = materialize(found.distinct().join(tested, ["u", "v"], "left_anti"))
        roots = _roots(roots, materialize(_verified(found, some, words, percent)))
        tested = materialize(tested.unionByName(found))
    named = sets.where("n > 0").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.select("node", "root").distinct().join(lowest, "root").select("node", "component_id")
    with_words = sets.where("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
