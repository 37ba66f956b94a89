"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

A tree for each length of vectors is fitted on a bounded sample; every vector descends it to a leaf, and the index holds the
vectors by leaf, in blocks. A query walks its tree once, through a priority queue of branches, and goes only to the blocks of
the leaves that it visits. The priority of a branch is the best inner product that its centre and spread lead to expect. It
visits as many leaves as calibration asks for: sample queries are widened, leaf by leaf, until the wanted share of their true
neighbours in the sample is reached. What it visits is scored exactly; sampled vectors in the visited leaves give each query
a floor, below which nothing is sent on.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .vectors import BLOCK, best, queries, ranked, results, unpack, usable

K = 20
#: Vectors that the trees are fitted on, at most.
SAMPLE = 20_000
BRANCHES = 8
#: Sampled vectors in a leaf at least, and rows of the whole table that a leaf should hold.
LEAF, LEAF_ROWS = 64, 2048
#: Leaves that a tree gets at least, if the sample allows it.
LEAST_LEAVES = 16
#: Sample queries, and the recall that they must reach.
CALIBRATION = 400
RECALL = 0.95
#: Standard deviations above a branch's centre that its best vector is expected at.
AHEAD = 2.0
#: Queries of a leaf that are scored together.
TOGETHER = 512


class Tree:
    """Centres and spreads of all nodes but the root; children by node; leaves numbered as they are met depth first."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int = 9):
        self.centres: list[np.ndarray] = [np.zeros(sample.shape[1])]
        self.spread: list[float] = [0.0]
        self.children: list[list[int]] = [[]]
        self.leaf_of: list[int] = [-1]
        self.leaves = 0
        self._grow(0, sample, leaf, np.random.default_rng(seed))
        self.matrix = np.stack(self.centres)
        self.visits = self.leaves
        self.held = self.assign(sample)

    def _grow(self, node: int, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> None:
        labels = _k_means(rows, BRANCHES, rng) if len(rows) > leaf else None
        if labels is None or labels.max() == 0:
            self.leaf_of[node] = self.leaves
            self.leaves += 1
            return
        for k in range(labels.max() + 1):
            own = rows[labels == k]
            self.centres.append(own.mean(axis=0))
            self.spread.append(float(np.sqrt(((own - self.centres[-1]) ** 2).mean())))
            self.children.append([])
            self.leaf_of.append(-1)
            self.children[node].append(len(self.centres) - 1)
            self._grow(self.children[node][-1], own, leaf, rng)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf in which each row's descent to the nearest centre ends."""
        at, out = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        active = np.arange(len(rows))
        while len(active):
            for node in np.unique(at[active]):
                here = active[at[active] == node]
                if self.leaf_of[node] >= 0:
                    out[here] = self.leaf_of[node]
                else:
                    kids = np.array(self.children[node])
                    c = self.matrix[kids]
                    at[here] = kids[((c * c).sum(axis=1)[None, :] - 2 * rows[here] @ c.T).argmin(axis=1)]
            active = active[out[active] < 0]
        return out

    def visited(self, rows: np.ndarray, visits: int) -> np.ndarray:
        """rows x visits: leaves in best-bin-first order."""
        order = np.empty((len(rows), min(visits, self.leaves)), np.int64)
        ahead = AHEAD * np.array(self.spread)
        for i, near in enumerate(rows @ self.matrix.T + np.linalg.norm(rows, axis=1)[:, None] * ahead[None, :]):
            queue, found = [(0.0, 0)], 0
            while found < order.shape[1]:
                _, node = heapq.heappop(queue)
                if self.leaf_of[node] >= 0:
                    order[i, found] = self.leaf_of[node]
                    found += 1
                else:
                    for kid in self.children[node]:
                        heapq.heappush(queue, (-near[kid], kid))
        return order

    def calibrate(self, sample: np.ndarray, k: int, recall: float, count: int) -> None:
        """The fewest leaf visits with which ``count`` sample queries find ``recall`` of their true neighbours."""
        if len(sample) < 2:
            return
        asked = np.arange(0, len(sample), max(1, len(sample) // count))[:count]
        own, ranks = self.held, []
        order = self.visited(sample[asked], self.leaves)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(self.leaves)[None, :].repeat(len(order), 0), axis=1)
        for i, q in enumerate(asked):
            scores = sample @ sample[q]
            scores[q] = -np.inf
            ranks.append(place[i, own[best(np.arange(len(sample)), scores, min(k, len(sample) - 1))]])
        ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0)
        if len(ranks):
            self.visits = int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Labels 0 .. with no empty cluster; equal rows share one."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    labels = np.zeros(len(rows), np.int64)
    for _ in range(rounds):
        new = ((centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)
        if np.array_equal(new, labels):
            break
        labels = new
        used = np.unique(labels)
        centres = np.stack([rows[labels == x].mean(axis=0) for x in used])
        labels = np.searchsorted(used, labels)
    return np.unique(labels, return_inverse=True)[1]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correctly rounded inner products of the rows of ``a`` with ``b``: equal vectors get equal scores."""
    return np.array([math.fsum(row) for row in (a * b).tolist()])


def _few_copies(ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Positions that can be among some query's k best: of equal vectors, only the k + 1 smallest ids can."""
    raw = np.ascontiguousarray(values).view(np.dtype((np.void, values.dtype.itemsize * values.shape[1]))).ravel()
    _, group, sizes = np.unique(raw, return_inverse=True, return_counts=True)
    if sizes.max() <= k + 1:
        return np.arange(len(ids))
    order = np.lexsort((ids, group))
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.sort(order[place <= k])


def scan(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, asked: np.ndarray, floors: np.ndarray, k: int) -> list:
    """The block's k best of each query that are not below its floor, with exact scores."""
    keep = _few_copies(ids, values, k)
    ids, values = ids[keep], values[keep]
    order = np.argsort(ids, kind="stable")
    out = []
    for at in range(0, len(asked), TOGETHER):
        scores, limit = asked[at : at + TOGETHER] @ values.T, floors[at : at + TOGETHER]
        first, last = (np.searchsorted(ids, query_ids[at : at + TOGETHER], side, sorter=order) for side in ("left", "right"))
        for i in np.nonzero(first < last)[0]:
            scores[i, order[first[i] : last[i]]] = -np.inf
        if scores.shape[1] > k and not np.isfinite(limit).all():
            limit = np.maximum(limit, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
        slack = np.where(np.isfinite(limit), 1e-9 * np.maximum(1.0, np.abs(limit)), 0.0)
        who, hit = np.nonzero((scores >= (limit - slack)[:, None]) & (scores > -np.inf))
        for i, open_ in zip(np.unique(who), np.split(hit, np.nonzero(np.diff(who))[0] + 1)):
            if len(open_) > 2 * k:
                row = scores[i, open_]
                least = np.partition(row, len(row) - k)[len(row) - k]
                open_ = open_[row >= least - 1e-9 * max(1.0, abs(least))]
            exact = _exact(values[open_], asked[at + i])
            top = best(ids[open_], exact, k)
            out.append((int(query_ids[at + i]), ids[open_[top]], exact[top]))
    return out


def fit(rows: DataFrame, total: int, k: int = K, bound: int = SAMPLE, recall: float = RECALL) -> dict[int, tuple[Tree, np.ndarray, np.ndarray]]:
    """By length: the tree on its share of at most ``bound`` vectors, by hash of the id, with its leaf visits calibrated, and
    the sample's ids and vectors. Lengths too rare for the sample have no tree: their vectors are one leaf."""
    found = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(bound).toArrow().combine_chunks()
    out = {}
    for batch in found.to_batches():
        ids = batch.column(0).to_numpy()
        for width, own, sample in _matrices(batch):
            share = -(-batch.num_rows * LEAF_ROWS // total)
            tree = Tree(sample, max(LEAF, min(share, len(sample) // LEAST_LEAVES)))
            tree.calibrate(sample, k, recall, CALIBRATION)
            out[width] = tree, ids[own], sample
    return out


def _floors(tree: Tree, sample_ids: np.ndarray, sample: np.ndarray, ids: np.ndarray, asked: np.ndarray, visit: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the sampled vectors that it visits; no bound where there are fewer."""
    out = np.full(len(asked), -np.inf)
    for i, row in enumerate(asked @ sample.T):
        open_ = np.nonzero(visit[i, tree.held] & (sample_ids != ids[i]))[0]
        if len(open_) >= k:
            out[i] = np.partition(row[open_], len(open_) - k)[len(open_) - k]
    return out


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, matrix) of the list column 1."""
    lists = batch.column(1)
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.cumsum(lengths)]
    for width in np.unique(lengths):
        own = np.nonzero(lengths == width)[0]
        yield int(width), own, flat[starts[own][:, None] + np.arange(width)[None, :]]


def _packed(rows: DataFrame) -> DataFrame:
    """(cell, vec_id, v) sorted by cell within partitions -> (cell, ids, data, width), at most BLOCK vectors in a row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            ids, matrix = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([now]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([matrix.astype("<f8").tobytes()], pa.binary()), pa.array([matrix.shape[1]])],
                ["cell", "ids", "data", "width"],
            )

        for batch in batches:
            cells, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy(zero_copy_only=False)
            for _, own, matrix in _matrices(batch):
                cuts = np.r_[0, np.nonzero(np.diff(cells[own]))[0] + 1, len(own)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    for at in range(a, b, BLOCK):
                        part = own[at : min(b, at + BLOCK)]
                        if held and (cells[part[0]] != now or size + len(part) > BLOCK):
                            yield out()
                            held, size = [], 0
                        now = int(cells[part[0]])
                        held.append((ids[part], matrix[at : at + len(part)]))
                        size += len(part)
        if held:
            yield out()

    return rows.select("vec_id", "v", "cell").mapInArrow(each, "cell long, ids binary, data binary, width long")


def neighbours(vectors: DataFrame, k: int = K, every: int = 20, recall: float = RECALL, bound: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the ``k`` nearest other rows
    that its visits meet, by inner product in double precision, ties to the smaller vec_id.

    Vectors of every length are indexed, all of them; vectors of different lengths are not compared. Null and zero vectors,
    and vectors with null or non-finite components, take no part. Rows repeated with one vec_id are all candidates and ask
    once; a query's own id is never among its results. Empty tables give empty results.
    """
    rows = usable(vectors, zero=True)
    total = rows.count()
    trees = vectors.sparkSession.sparkContext.broadcast(fit(rows, total, k, bound, recall))  # at most ``bound`` vectors and centres

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.zeros(batch.num_rows, np.int64)
            for width, own, matrix in _matrices(batch):
                if width in trees.value:
                    leaf[own] = trees.value[width][0].assign(matrix)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["vec_id", "v", "leaf"])

    where = (F.size("v").cast("long") * (1 << 20) + F.col("leaf")).alias("leaf")
    leaved = materialize(rows.mapInArrow(placed, "vec_id long, v array<double>, leaf long").select("vec_id", "v", where))
    parts = materialize(leaved.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    cell = F.xxhash64("leaf", F.pmod(F.monotonically_increasing_id(), F.col("parts"))).alias("cell")
    index = _packed(leaved.join(parts, "leaf").select("vec_id", "v", cell).repartition("cell").sortWithinPartitions("cell", F.size("v")))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for width, own, matrix in _matrices(batch):
                tree, sample_ids, sample = trees.value.get(width, (None, None, None))
                for at in range(0, len(own), TOGETHER):
                    asked, asking = matrix[at : at + TOGETHER], ids[own[at : at + TOGETHER]]
                    visit = np.zeros((len(asked), tree.leaves if tree else 1), bool)
                    floors = np.full(len(asked), -np.inf)
                    if tree is None:
                        visit[:] = True
                    else:
                        np.put_along_axis(visit, tree.visited(asked, tree.visits), True, axis=1)
                        floors = _floors(tree, sample_ids, sample, asking, asked, visit, k)
                    for leaf in np.nonzero(visit.any(axis=0))[0]:
                        who = visit[:, leaf]
                        data = np.concatenate([asked[who], floors[who, None]], axis=1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([width * (1 << 20) + int(leaf)]), pa.array([asking[who].astype("<i8").tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())],
                            ["leaf", "q_ids", "q_data"],
                        )

    routed = queries(rows, every).select("vec_id", "v").mapInArrow(walked, "leaf long, q_ids binary, q_data binary").join(parts, "leaf")
    asked = routed.select("leaf", "q_ids", "q_data", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = asked.select(F.xxhash64("leaf", F.col("part").cast("long")).alias("cell"), "q_ids", "q_data")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                width, c_ids, c_data, q_ids, q_data = (c[row].as_py() for c in batch.columns)
                ids, values = unpack(c_ids, c_data, width)
                query_ids, vectors = unpack(q_ids, q_data, width + 1)
                yield from results(scan(ids, values, query_ids, vectors[:, :width], vectors[:, width], k))

    met = index.join(asked, "cell").select("width", "ids", "data", "q_ids", "q_data")
    return ranked(met.mapInArrow(each, "query_id long, vec_id long, score double"), k)
