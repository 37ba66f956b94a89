"""Exact top-k by inner product with no-random-access aggregation.

A block of candidates is read as one sorted list for each component, step by step, from both ends of every list. What a list
has not shown of a candidate lies between the two values reached, so a candidate's score lies between a lower and an upper
bound, which close as reading goes on. A query stops as soon as few candidates outside its k best lower bounds can still
reach them; the scores of those left are then resolved exactly. What a query found in one block is the floor that its bounds
in the next have to reach. All queries of a block are bounded together: the bounds after a step are the products of the
queries with the middles, and of their sizes with the half widths, of what the lists leave open. Where nothing can be told
apart before (equal vectors), the lists are read to their ends, and then the bounds are the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import materialize
from .vectors import BLOCK, best, blocks, cells, queries, ranked, results, unpack, usable

SCALE = 64.0
K = 20
#: Shares of the lists' entries after which the bounds are compared.
STEPS = (0.7, 0.8, 0.88, 0.94, 0.97, 1.0)
QUERY_BLOCK = 4096
#: Queries that are bounded at once, and blocks of candidates that are searched one after the other.
TOGETHER, STRIP = 512, 4


class SortedLists:
    """A block's integer vectors as one list for each component: the values in order, and each candidate's place in it."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        order = np.argsort(values, axis=0, kind="stable")
        self.place = np.empty_like(order, dtype=np.int32)
        np.put_along_axis(self.place, order, np.arange(len(values), dtype=np.int32)[:, None], axis=0)
        self.sorted = np.take_along_axis(values, order, axis=0)

    def read(self, share: float) -> tuple[np.ndarray, np.ndarray]:
        """After ``share`` of all entries, half of them from either end: the middle and the half width of what each
        candidate's component can be; a shown one is its own middle."""
        n = len(self.values)
        top = n if share >= 1 else max(1, int(n * share / 2))
        bottom = min(top, n - top)
        if top >= n or top + bottom >= n:
            return self.values, np.zeros_like(self.values)
        shown = (self.place < bottom) | (self.place >= n - top)
        low, high = self.sorted[bottom - 1], self.sorted[n - top]
        return np.where(shown, self.values, (low + high) / 2), np.where(shown, 0.0, (high - low) / 2)


def search(lists: SortedLists, query_ids: np.ndarray, asked: np.ndarray, k: int = K, floors: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """(query id, candidate ids, exact integer scores best first, share of the entries read) of each query in the block.

    floors: the k best scores of each query so far, brought up to date; what cannot be among them is left out."""
    floors = {} if floors is None else floors
    n, width = lists.values.shape
    most = float(np.abs(asked).max(initial=0)) * float(np.abs(lists.values).max(initial=0)) * width
    kind = np.float32 if most < 2**22 else np.float64
    slack = 0.0 if most < 2**51 else most * 1e-14
    place = {int(x): [] for x in query_ids}
    for at, x in enumerate(lists.ids.tolist()):
        if x in place:
            place[x].append(at)
    whole = lists.values.astype(np.int64)
    open_ = np.arange(len(asked))
    for share in STEPS:
        if not len(open_):
            return
        middle, width_ = (x.astype(kind) for x in lists.read(share))
        still = []
        for start in range(0, len(open_), TOGETHER):
            part = open_[start : start + TOGETHER]
            q = asked[part].astype(kind)
            mid, half = q @ middle.T, np.abs(q) @ width_.T
            lower, upper = mid - half, mid + half
            for i, at in enumerate(part):
                own = place[int(query_ids[at])]
                lower[i, own] = upper[i, own] = -np.inf
            reached = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(part), -np.inf)
            for i, at in enumerate(part):
                known = floors.get(int(query_ids[at]))
                floor = max(float(reached[i]), float(known[0]) if known is not None and len(known) == k else -np.inf)
                rest = np.nonzero((upper[i] >= floor - slack) & (upper[i] > -np.inf))[0]
                if len(rest) > max(4 * k, n // 64) and share < 1:
                    still.append(at)
                    continue
                scores = whole[rest] @ asked[at].astype(np.int64)
                top = best(lists.ids[rest], scores, k)
                held = scores[top] if known is None else np.concatenate([known, scores[top]])
                floors[int(query_ids[at])] = np.sort(held)[-k:]
                yield int(query_ids[at]), lists.ids[rest[top]], scores[top], share
        open_ = np.array(still, np.int64)


def top_k(vectors: DataFrame, k: int = K, every: int = 20, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the ``k`` other rows with the
    highest inner product of floor(scale * component), all if there are fewer; ties go to the smaller vec_id.

    Vectors of different lengths are not compared. Rows that are null or hold null or non-finite components, and rows
    without an id, take no part. Rows repeated with one vec_id are all candidates and ask once; a query's own id is never
    among its results. Equal vectors tie. Empty tables give empty results.
    """
    rows = usable(vectors, zero=False)
    candidates = materialize(blocks(rows, block, scale))
    asked = materialize(blocks(queries(rows, every), QUERY_BLOCK, scale))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, floors = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                q, width, c_ids, c_data, q_ids, q_data = (c[row].as_py() for c in batch.columns)
                if q != now:
                    now, floors = q, {}
                query_ids, vectors = unpack(q_ids, q_data, width)
                found = search(SortedLists(*unpack(c_ids, c_data, width)), query_ids, vectors, k, floors)
                yield from results([x[:3] for x in found])

    return ranked(cells(candidates, asked, STRIP).mapInArrow(each, "query_id long, vec_id long, score long"), k)
