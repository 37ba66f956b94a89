"""Rank correlation, distances, and how well partitions agree, as joins and aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Securities in a block; pairs of blocks are correlated in one task.
BLOCK = 256


def _average_ranks(x: np.ndarray) -> np.ndarray:
    """By column, ties averaged."""
    order = np.argsort(x, axis=0, kind="stable")
    value = np.take_along_axis(x, order, axis=0)
    out = np.empty(x.shape)
    place = np.arange(1.0, len(x) + 1)
    for j in range(x.shape[1]):
        starts = np.nonzero(np.r_[True, value[1:, j] != value[:-1, j]])[0]
        sizes = np.diff(np.r_[starts, len(x)])
        out[order[:, j], j] = np.repeat(np.add.reduceat(place, starts) / sizes, sizes)
    return out


def spearman_matrix(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared dates, correlation) of every column of ``left`` with every column of ``right``, dates in rows, NaN for none.
    Columns without gaps are ranked once and meet in one matrix product; pairs with gaps are ranked on the dates they share."""
    n = np.empty((left.shape[1], right.shape[1]), np.int64)
    out = np.full(n.shape, np.nan)
    whole = [np.isfinite(x).all(axis=0) for x in (left, right)]
    n[:] = np.isfinite(left).T.astype(np.int64) @ np.isfinite(right).astype(np.int64)

    def scaled(x: np.ndarray) -> np.ndarray:
        r = _average_ranks(x)
        r -= r.mean(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            return r / np.sqrt((r * r).sum(axis=0))

    if whole[0].any() and whole[1].any() and len(left):
        out[np.ix_(*whole)] = scaled(left[:, whole[0]]).T @ scaled(right[:, whole[1]])
    for i, j in np.argwhere(~np.outer(*whole)):
        both = np.isfinite(left[:, i]) & np.isfinite(right[:, j])
        if both.sum() > 1:
            pair = scaled(np.stack([left[both, i], right[both, j]], axis=1))
            out[i, j] = pair[:, 0] @ pair[:, 1]
    return n, np.clip(out, -1, 1)


def _block_pairs(pdf: pd.DataFrame, first: int, second: int) -> pd.DataFrame:
    """(a, b, n, spearman) of all pairs of the two blocks, or of all pairs within one."""
    wide = pdf.pivot(index="date", columns="security", values="simple_return")
    block = pdf.groupby("security")["block"].first().reindex(wide.columns).to_numpy()
    names, sides = wide.columns.to_numpy(), [np.nonzero(block == k)[0] for k in (first, second)]
    values = wide.to_numpy(float)
    n, found = spearman_matrix(values[:, sides[0]], values[:, sides[1]])
    i, j = np.nonzero(n > 0)
    left, right = names[sides[0][i]], names[sides[1][j]]
    keep = left < right if first == second else np.ones(len(left), bool)
    a, b = np.where(left < right, left, right), np.where(left < right, right, left)
    return pd.DataFrame({"a": a[keep], "b": b[keep], "n": n[i, j][keep], "spearman": found[i, j][keep]})


def pairwise_spearman(panel: DataFrame, least: float = 0.8, *by: str) -> DataFrame:
    """(by, a, b, n, spearman), a < b: ranks with ties averaged over the dates that both have, then their correlation; null
    where the pair shares fewer than ``least`` of all dates. Securities are dealt into blocks of about BLOCK, a series goes to
    the block pairs that it takes part in, and each block pair is one task."""
    keys = list(by)
    total = panel.groupBy(*keys).agg(F.countDistinct("date").alias("dates"), F.greatest(F.lit(1), F.ceil(F.approx_count_distinct("security") / BLOCK)).cast("int").alias("blocks"))
    rows = panel.where("simple_return is not null").select(*keys, "security", "date", F.col("simple_return").cast("double").alias("simple_return"))
    rows = rows.join(F.broadcast(total), keys) if keys else rows.join(F.broadcast(total))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("security"), F.col("blocks")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", meets).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _block_pairs(pdf, int(key[-2]), int(key[-1]))
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "a", "b", "n", "spearman"]]

    kinds = dict(panel.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "a string, b string, n long, spearman double"
    found = rows.select(*keys, "security", "date", "simple_return", "block", "first", "second").groupBy(*keys, "first", "second").applyInPandas(each, schema)
    found = found.join(F.broadcast(total), keys) if keys else found.join(F.broadcast(total))
    enough = (F.col("n") >= F.ceil(F.col("dates") * F.lit(least))) & ~F.isnan("spearman")
    return found.select(*keys, "a", "b", "n", F.when(enough, F.col("spearman")).alias("spearman"))


def correlation_distance(pairs: DataFrame) -> DataFrame:
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("spearman")))
    return pairs.withColumn("distance", F.when(F.col("spearman").isNotNull(), F.sqrt((1 - clipped) / 2)))


def dependence_gap(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean correlation of pairs within groups less that of pairs between groups, over pairs and balanced over groups."""
    label = lambda name: labels.select(F.col("security").alias(name), F.col("group_id").alias(f"{name}_group"))
    rows = pairs.join(label("a"), "a").join(label("b"), "b").withColumn("within", F.col("a_group") == F.col("b_group"))
    cell = rows.groupBy("within", F.least("a_group", "b_group").alias("g"), F.greatest("a_group", "b_group").alias("h")).agg(
        F.avg("spearman").alias("mean"), F.sum("spearman").alias("total"), F.count("spearman").alias("n")
    )
    pick = lambda column, side: F.when(F.col("within") == F.lit(side), F.col(column))
    out = cell.agg(
        *[(F.sum(pick("total", s)) / F.sum(pick("n", s))).alias(f"{name}_mean") for s, name in ((True, "within"), (False, "between"))],
        (F.avg(pick("mean", True)) - F.avg(pick("mean", False))).alias("balanced_gap"),
    )
    return out.withColumn("gap", F.col("within_mean") - F.col("between_mean"))


def contingency(rows: DataFrame, left: str, right: str) -> DataFrame:
    return rows.groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count("*").alias("n"))


def adjusted_rand_index(rows: DataFrame, left: str, right: str) -> DataFrame:
    """From the contingency table alone; 1 where the expected and largest agreement coincide and are reached."""
    cells = contingency(rows, left, right)
    two = lambda n: n * (n - 1) / 2
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias(f"same_{c}"), F.sum("n").alias(f"n_{c}"))
    both = cells.agg(F.sum(two(F.col("n"))).alias("same"))
    expected = F.col("same_l") * F.col("same_r") / two(F.col("n_l"))
    most = (F.col("same_l") + F.col("same_r")) / 2
    index = F.when(F.abs(most - expected) < 1e-15, F.when(F.abs(F.col("same") - most) < 1e-12, 1.0).otherwise(0.0)).otherwise((F.col("same") - expected) / (most - expected))
    return both.join(side("l")).join(side("r")).select(index.alias("ari"))


def normalized_mutual_information(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Mutual information over the mean of the two entropies; 1 if both partitions are trivial."""
    cells = contingency(rows, left, right)
    joint = cells.withColumns(
        {"nl": F.sum("n").over(Window.partitionBy("l")), "nr": F.sum("n").over(Window.partitionBy("r"))}
    ).join(cells.agg(F.sum("n").alias("total")))
    p = F.col("n") / F.col("total")
    out = joint.agg(
        F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("nl") * F.col("nr")))).alias("mi"),
        F.sum(-p * F.log(F.col("nl") / F.col("total"))).alias("hl"),
        F.sum(-p * F.log(F.col("nr") / F.col("total"))).alias("hr"),
    )
    mean = (F.col("hl") + F.col("hr")) / 2
    return out.select(F.when(mean < 1e-15, 1.0).otherwise(F.col("mi") / mean).alias("nmi"))
