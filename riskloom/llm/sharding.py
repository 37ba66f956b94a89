"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group that stays in one shard. Groups are dealt into blocks by hash; each block is differenced on its
own, which leaves a tuple of ``shards`` partial sums that are almost equal, and the driver differences the blocks' tuples
in the same way. A block holds BLOCK_GROUPS or about sqrt(shards * groups)
groups, whichever is more, so neither a task nor the driver sees more than that.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

SHARDS = 16
#: Groups that one task differences at least, where there are so many; small blocks balance less well.
BLOCK_GROUPS = 20_000


def difference(tuples: list[list[tuple[int, object]]], shards: int) -> list[list]:
    """tuples: lists of (sum, member), at most ``shards`` each. Repeatedly combines the two tuples of largest spread, the
    largest sums of one with the smallest of the other. Returns the members of each of ``shards`` parts."""
    heap = []
    for order, items in enumerate(tuples):
        part = sorted(((s, i) for i, (s, _) in enumerate(items)), key=lambda x: (x[0], x[1]))
        sums = [0] * (shards - len(part)) + [s for s, _ in part]
        held = [None] * (shards - len(part)) + [(items[i][1],) for _, i in part]
        heap.append((sums[0] - sums[-1], order, sums, held))
    heapq.heapify(heap)
    order = len(tuples)
    while len(heap) > 1:
        _, _, a, held_a = heapq.heappop(heap)
        _, _, b, held_b = heapq.heappop(heap)
        joined = []
        for i in range(shards):
            x, y = held_a[i], held_b[shards - 1 - i]
            joined.append((a[i] + b[shards - 1 - i], i, x if y is None else y if x is None else [x, y]))
        joined.sort()
        low = joined[0][0]
        sums = [s - low for s, _, _ in joined]
        heapq.heappush(heap, (-sums[-1], order, sums, [h for _, _, h in joined]))
        order += 1
    parts = []
    for held in heap[0][3] if heap else [None] * shards:
        members, stack = [], [held]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                members.append(x[0])
            elif x is not None:
                stack += x
        parts.append(members)
    return parts


def _block_parts(groups: DataFrame, blocks: int, shards: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for block, h1, h2, size in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(block, []).append((size, h1, h2))
        for block in sorted(held):
            items = sorted(held.pop(block), key=lambda x: (-x[0], x[1], x[2]))
            out = [[], [], [], [], []]
            for part, members in enumerate(difference([[(x[0], i)] for i, x in enumerate(items)], shards)):
                for i in members:
                    for column, value in zip(out, (block, part, items[i][1], items[i][2], items[i][0])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out], ["block", "part", "h1", "h2", "group_bytes"]
            )

    dealt = groups.select(F.pmod("h1", F.lit(blocks)).alias("block"), "h1", "h2", "group_bytes").repartition(blocks, "block")
    return dealt.mapInArrow(each, "block long, part long, h1 long, h2 long, group_bytes long")


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    size: UTF-8 bytes of the text plus 1; a null text has no bytes (size 1, checksum 0) and groups only with other nulls.
    Rows of equal texts share a shard; a group larger than a shard's share stays whole, so balance is then bounded by it.
    slot numbers a shard's rows from 0 without gaps, by hash bucket, doc_id and text hash. grown_shard is null: a shard
    depends on all rows. Repeated rows get slots of their own. An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(F.lit(1), text.isNull(), text).alias("h1"),
            F.xxhash64(F.lit(2), text.isNull(), text).alias("h2"),
        )
    )
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("group_bytes"))
    count, total = groups.count(), rows.count()
    blocks = max(1, -(-count // max(BLOCK_GROUPS, math.isqrt(shards * count))))
    parts = materialize(_block_parts(groups, blocks, shards))
    sums: dict[int, list] = {}
    for block, part, size in parts.groupBy("block", "part").agg(F.sum("group_bytes")).orderBy("block", "part").collect():
        sums.setdefault(block, []).append((size, (block, part)))
    named = [
        (block, part, shard) for shard, members in enumerate(difference([sums[b] for b in sorted(sums)], shards)) for block, part in members
    ]
    shard_of = docs.sparkSession.createDataFrame(named, "block long, part long, shard int")
    placed = rows.join(parts.join(shard_of, ["block", "part"]).select("h1", "h2", "shard"), ["h1", "h2"])
    buckets = max(1, total // (shards * max(256, math.isqrt(total))))
    placed = materialize(placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(buckets))))
    held = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "h1", "h2")
    return (
        placed.withColumn("at", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
