"""Conflict-constrained best-fit packing of documents into bins of words.

Documents longer than a bin are cut: every full bin's worth stands alone and the rest is packed. The rest pieces are dealt
by hash into groups of bounded size, and each group is packed on its own, largest piece first. Bins lie in order of what
is left in them and carry two bitmaps, of the sources and of the duplicate clusters they hold. A piece goes to the
tightest bin that has room and neither its source nor its cluster: the search starts at the first bin with room enough and
goes on to the next larger until one is compatible; failing that, a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import words
from .store import materialize

CAPACITY = 2048
#: Pieces packed together in one task, about.
GROUP = 8192


def pack_group(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """items: (words, source bit, cluster bit), bits as numbers, -1 for none. Returns each item's (bin, offset)."""
    open_: list[tuple[int, int]] = []  # (words left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    placed = [(0, 0)] * len(items)
    for i in sorted(range(len(items)), key=lambda x: (-items[x][0], x)):
        size, source, cluster = items[i]
        in_source, in_cluster = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(open_, (size, -1))
        while at < len(open_) and (sources[open_[at][1]] & in_source or clusters[open_[at][1]] & in_cluster):
            at += 1
        if at < len(open_):
            left, bin_ = open_.pop(at)
        else:
            left, bin_ = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[bin_] |= in_source
        clusters[bin_] |= in_cluster
        placed[i] = (bin_, capacity - left)
        if left > size:
            insort(open_, (left - size, bin_))
    return placed


def _cluster(text: Column) -> Column:
    """Texts that differ in case, marks or spacing only are one cluster."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]++", " ")))


def packed(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, first_word, words, bin, bin_offset, source, cluster): pieces of all rows and where they lie.

    piece counts a row's pieces from 0, first_word is where a piece starts in its text. bin is ``group:number``; full pieces
    have bins ``full:row:piece`` of their own. No bin holds more than ``capacity`` words, two pieces of one source or two of
    one cluster (rest pieces without a source do not conflict by source). Rows that are null or blank have one piece of no
    words, which takes no room in any bin: its bin is null. Repeated rows are in one cluster, so they lie in different bins.
    An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            words(text).alias("size"),
            _cluster(F.coalesce(text, F.lit(""))).alias("cluster"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    full = F.floor(F.col("size") / capacity).cast("int")
    rest = rows.withColumn("words", F.col("size") - full * capacity).withColumn("piece", full)
    loose = rest.where("words > 0")
    groups = max(1, -(-loose.count() // group))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(g, []).append(row)
        for g in sorted(held):
            own = sorted(held.pop(g))
            source_bits: dict[str, int] = {}
            counts: dict[int, int] = {}
            for r in own:
                counts[r[3]] = counts.get(r[3], 0) + 1
            cluster_bits = {c: k for k, c in enumerate(sorted(c for c, n in counts.items() if n > 1))}
            items = [(r[1], -1 if r[2] is None else source_bits.setdefault(r[2], len(source_bits)), cluster_bits.get(r[3], -1)) for r in own]
            places = pack_group(items, capacity)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in own], pa.int64()), pa.array([f"{g}:{b}" for b, _ in places], pa.string()), pa.array([o for _, o in places], pa.int64())],
                ["row", "bin", "bin_offset"],
            )

    dealt = loose.select(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("g"), "row", "words", "source", "cluster").repartition(groups, "g")
    places = dealt.mapInArrow(each, "row long, bin string, bin_offset long")
    lying = loose.join(places, "row").select("doc_id", "piece", "words", "bin", "bin_offset", "source", "cluster")
    alone = rows.where(F.col("size") >= capacity).select(
        "doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.lit(capacity).cast("long").alias("words"), "row", "source", "cluster"
    )
    alone = alone.select("doc_id", "piece", "words", F.concat_ws(":", F.lit("full"), "row", "piece").alias("bin"), F.lit(0).cast("long").alias("bin_offset"), "source", "cluster")
    none = rows.where("size = 0").select(
        "doc_id", F.lit(0).alias("piece"), F.col("size").alias("words"), F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("bin_offset"), "source", "cluster"
    )
    return lying.unionByName(alone).unionByName(none).select(
        "doc_id", "piece", (F.col("piece") * F.lit(capacity).cast("long")).alias("first_word"), "words", "bin", "bin_offset", "source", "cluster"
    )
