"""Blocks of packed vectors, and what searches do with them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block at most.
BLOCK = 4096


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v): vectors as double arrays, without those that are null or hold null or non-finite components, and, if
    ``zero``, without those of length zero; null ids take no part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad
    )
    return rows.where(F.exists("v", lambda x: x != 0)) if zero else rows


def pack(ids: np.ndarray, matrix: np.ndarray) -> tuple[bytes, bytes, int]:
    return ids.astype("<i8").tobytes(), np.ascontiguousarray(matrix).tobytes(), matrix.shape[1] if matrix.ndim == 2 else 0


def unpack(ids: bytes, data: bytes, width: int, kind: str = "<f8") -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, kind).reshape(-1, width)


def blocks(rows: DataFrame, size: int = BLOCK, scale: float | None = None) -> DataFrame:
    """(vec_id, v) -> (block, ids, data, width): full blocks of vectors of one width, as they lie in the partitions.
    ``scale``: components become floor(scale * x)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = count(TaskContext.get().partitionId() << 32)

        def out(width: int, ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
            a, b, w = pack(ids, matrix)
            return pa.RecordBatch.from_arrays([pa.array([next(made)]), pa.array([a], pa.binary()), pa.array([b], pa.binary()), pa.array([w])], ["block", "ids", "data", "width"])

        def drained(width: int, least: int) -> Iterator[pa.RecordBatch]:
            parts = held.pop(width)
            ids, matrix = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            at = 0
            while len(ids) - at >= max(least, 1):
                yield out(width, ids[at : at + size], matrix[at : at + size])
                at += size
            if at < len(ids):
                held[width] = [(ids[at:], matrix[at:])]

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(lengths)]
            for width in np.unique(lengths):
                rows = np.nonzero(lengths == width)[0]
                matrix = flat[starts[rows][:, None] + np.arange(width)[None, :]]
                held.setdefault(int(width), []).append((ids[rows], np.floor(matrix * scale) if scale else matrix))
                if sum(len(x) for x, _ in held[int(width)]) >= size:
                    yield from drained(int(width), size)
        for width in list(held):
            yield from drained(width, 1)

    return rows.select("vec_id", "v").mapInArrow(each, "block long, ids binary, data binary, width long")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.nonzero(scores >= limit)[0]
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def queries(rows: DataFrame, every: int) -> DataFrame:
    """The stated queries: rows whose id is divisible by ``every``; of rows that repeat an id, the smallest vector."""
    return rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def cells(candidates: DataFrame, asked: DataFrame, strip: int) -> DataFrame:
    """Every block of the stated queries beside every block of candidates of the same width, by joins on numbered pairs of
    blocks: (q, width, c_ids, c_data, q_ids, q_data). About ``strip`` blocks of candidates follow each other for a block of
    queries, so that what was found in one bounds the search of the next."""
    c = candidates.select(F.col("block").alias("c"), "width", F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    q = asked.select(F.col("block").alias("q"), "width", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    strips = max(1, -(-candidates.count() // strip))
    pairs = c.select("c", "width").join(q.select("q", "width"), "width")
    met = pairs.join(c.drop("width"), "c").join(q.drop("width"), "q").withColumn("strip", F.pmod(F.xxhash64("c"), F.lit(strips)))
    ordered = met.repartition("q", "strip").sortWithinPartitions("q", "strip", "c")
    return ordered.select("q", "width", "c_ids", "c_data", "q_ids", "q_data")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of all cells -> each query's k best."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def results(found: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        sizes = [len(x) for _, x, _ in found]
        columns = [np.repeat([q for q, _, _ in found], sizes), np.concatenate([x for _, x, _ in found]), np.concatenate([s for _, _, s in found])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "vec_id", "score"])
