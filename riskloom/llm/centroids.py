"""Centroid clustering by kd-tree filtering.

Each partition packs its vectors into blocks and builds a kd-tree over each block: every node holds how many vectors it has, their
exact integer sum and their box. A round walks the trees from the root with the set of centroids that can still be nearest. A centroid
goes where another one is strictly nearer to every point of the node's box; a node with one centroid left is assigned whole, from its
count and sum; a leaf with more is resolved point by point. All of it is integer arithmetic, so results do not depend on how rows lie.
Trees are built once and stay in the shared folder; a round sends k counts and k sums of one task to the aggregate, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .vectors import usable

#: Vectors in a tree and in a leaf at most (a leaf of equal vectors may hold more).
BLOCK, LEAF = 8192, 32
#: Components are held within this size, so that every squared distance fits a long (up to 64 components).
LIMIT = 1 << 27
_TREE = "ids binary, data binary, low binary, high binary, total binary, span binary"


@dataclass
class Tree:
    """Vectors in the tree's order, and per node: box, sum, and (start, end, left, right); a leaf has no left child (-1)."""

    ids: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray
    span: np.ndarray

    def packed(self) -> list[bytes]:
        return [self.ids.astype("<i8").tobytes(), *(x.astype("<i4").tobytes() for x in (self.points, self.low, self.high)), self.total.astype("<i8").tobytes(), self.span.astype("<i4").tobytes()]

    @staticmethod
    def unpacked(row: list[bytes], dims: int) -> Tree:
        parts = [np.frombuffer(x, kind).astype(np.int64) for x, kind in zip(row, ("<i8", "<i4", "<i4", "<i4", "<i8", "<i4"))]
        return Tree(parts[0], *(x.reshape(-1, dims) for x in parts[1:5]), parts[5].reshape(-1, 4))


def _whole(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype(np.int64)


def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree of the points: nodes are cut at the median of their widest component, parents come before their children."""
    order, low, high, total, span = np.arange(len(ids)), [], [], [], []
    open_ = [(0, len(ids), -1, 0)]
    for start, end, parent, side in open_:  # grows as it is read
        own = points[order[start:end]]
        a, b = own.min(axis=0), own.max(axis=0)
        if parent >= 0:
            span[parent][2 + side] = len(span)
        widest = int(np.argmax(b - a))
        if end - start > leaf and a[widest] < b[widest]:
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, widest], middle)]
            open_ += [(start, start + middle, len(span), 0), (start + middle, end, len(span), 1)]
        low.append(a)
        high.append(b)
        total.append(own.sum(axis=0))
        span.append([start, end, -1, -1])
    return Tree(ids[order], points[order], *(np.array(x, np.int64) for x in (low, high, total, span)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact a @ b.T of whole numbers: in floating point where no sum can reach 2^53."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64) if largest < 2**52 else a @ b.T


def dominated(low: np.ndarray, high: np.ndarray, alive: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """nodes x centroids: those of ``alive`` that lie strictly farther from every point of the node's box than the centroid nearest
    to the box's middle does."""
    out, norm = np.zeros_like(alive), (centroids * centroids).sum(axis=1)
    middle = norm - _product(low + high, centroids)  # squared distance from the middle, less what all centroids share
    nearest = np.argmin(np.where(alive, middle, np.iinfo(np.int64).max), axis=1)
    for z in np.unique(nearest):
        rows, apart = np.nonzero(nearest == z)[0], centroids - centroids[z]
        most = _product(high[rows], np.maximum(apart, 0)) + _product(low[rows], np.minimum(apart, 0))
        out[rows] = alive[rows] & (norm - norm[z] - 2 * most > 0)
    return out


def walk(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes assigned whole, their centroids, positions of the points resolved one by one, their centroids); ties go to the smaller
    centroid."""
    whole, owners, left, masks = [], [], [], []
    nodes, alive = np.array([0]), np.ones((1, len(centroids)), bool)
    while len(nodes):
        alive = alive & ~dominated(tree.low[nodes], tree.high[nodes], alive, centroids)
        one = alive.sum(axis=1) == 1
        whole.append(nodes[one])
        owners.append(np.argmax(alive[one], axis=1))
        leaf = ~one & (tree.span[nodes, 2] < 0)
        for node, mask in zip(nodes[leaf], alive[leaf]):
            left.append(np.arange(*tree.span[node, :2]))
            masks.append(np.broadcast_to(mask, (len(left[-1]), len(mask))))
        deeper = ~one & ~leaf
        nodes, alive = tree.span[nodes[deeper], 2:].ravel(), np.repeat(alive[deeper], 2, axis=0)
    places = np.concatenate(left) if left else np.zeros(0, np.int64)
    nearest = np.zeros(0, np.int64)
    if len(places):
        far = (centroids * centroids).sum(axis=1) - 2 * _product(tree.points[places], centroids)
        nearest = np.argmin(np.where(np.concatenate(masks), far, np.iinfo(np.int64).max), axis=1)
    return np.concatenate(whole), np.concatenate(owners), places, nearest


def trees(vectors: DataFrame, dims: int, scale: float) -> DataFrame:
    """(vec_id, v) of ``dims`` components -> packed trees of floor(scale * x)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def drained(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal ids, points
            while len(ids) >= least:
                row = build(ids[:BLOCK], points[:BLOCK]).packed()
                ids, points = ids[BLOCK:], points[BLOCK:]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], [x.split()[0] for x in _TREE.split(", ")])

        ids, points = np.zeros(0, np.int64), np.zeros((0, dims), np.int64)
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            now = _whole(flat, scale)
            ids, points = np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([points, now])
            yield from drained(BLOCK)
        yield from drained(1)

    return vectors.select("vec_id", "v").mapInArrow(each, _TREE)


def sums(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """k x (1 + dims): how many vectors each centroid has, and their sum."""
    k, dims = centroids.shape

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                tree = Tree.unpacked(row, dims)
                whole, owners, places, nearest = walk(tree, centroids)
                counts = tree.span[whole, 1] - tree.span[whole, 0]
                np.add.at(found, owners, np.column_stack([counts, tree.total[whole]]))
                np.add.at(found, nearest, np.column_stack([np.ones(len(places), np.int64), tree.points[places]]))
        cell = np.nonzero(found.ravel())[0]
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(found.ravel()[cell])], ["cell", "value"])

    out = np.zeros(k * (dims + 1), np.int64)
    for cell, value in packed.mapInArrow(each, "cell long, value long").groupBy("cell").agg(F.sum("value")).collect():
        out[cell] = value
    return out.reshape(k, dims + 1)


def assigned(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dims = centroids.shape[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                tree = Tree.unpacked(row, dims)
                whole, owners, places, nearest = walk(tree, centroids)
                cluster = np.zeros(len(tree.ids), np.int64)
                for (start, end), owner in zip(tree.span[whole, :2], owners):
                    cluster[start:end] = owner
                cluster[places] = nearest
                distance = ((tree.points - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(tree.ids), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return packed.mapInArrow(each, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, salt: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with exactly ``dims`` components, none
    null or non-finite, as the whole numbers floor(scale * x).

    Centroids start as the k vectors with the smallest SHA-256 of ``<salt>:<vec_id>`` (all of them, if fewer; of rows that repeat
    an id, the smaller vector comes first) and move ``rounds`` times; one without vectors stays where it is. Ties go to the smaller number.
    Vectors without an id take no part; repeated rows stay repeated. Components beyond 2^27 in size count as 2^27; an
    inertia that no long can hold is null. Extra columns take no part. An empty table gives an empty result.
    """
    if dims > 64:
        raise ValueError("squared distances of more than 64 components may not fit a long")
    spark = vectors.sparkSession
    rows = usable(vectors, zero=False).where(F.size("v") == dims)
    packed = materialize(trees(rows, dims, scale))
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(name, "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = _whole(np.array([r.v for r in first]), scale)
    for _ in range(rounds):
        found = sums(packed, centroids)
        count, total = found[:, :1], found[:, 1:]
        centroids = np.where(count > 0, total // np.maximum(count, 1), centroids)
    result = materialize(assigned(packed, centroids))
    inertia = dict(result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # k rows at most
    fits = lambda x: int(x) if x < 1 << 63 else None
    named = [(z, fits(own), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[z])).encode()).hexdigest()) for z, own in inertia.items()]
    ends = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return result.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
