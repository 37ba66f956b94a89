"""Connected components of an edge table, without collecting nodes or edges anywhere.

Alternating large-star and small-star rounds: each round is two aggregates and two equi-joins, and every round's edges
are written to the shared folder. A node with very many neighbours is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def _state(edges: DataFrame) -> tuple:
    """How many edges there are and the exclusive or of their hashes, which no number of edges can overflow."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) long edges, any direction, repeats and self-loops allowed -> (node, root): every node that has an edge to
    another node, with the smallest node of its component. An empty edge table gives an empty result."""
    current = materialize(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = _state(current)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        current = materialize(small)
        after = _state(current)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("star contraction did not converge")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
