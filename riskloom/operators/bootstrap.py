"""Circular block bootstrap within calendar years, its index stream, and the paired gap statistic over replications.

One stream draws the blocks of all candidates, in order, years within a candidate; that is a few numbers a candidate and is done on
the driver. Returns stay in tasks: each takes a year and a share of the candidates. A candidate in which some security is
constant in some year is left out as a whole and the stream goes on, so the accepted ones are the first that are not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import require_none

SEED = 5110
#: Candidates drawn beyond the replications at first, and at most for each replication.
SPARE, MOST = 64, 100


def generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64DXSM(np.random.SeedSequence(list(key))))


def block_starts(sizes: list[int], length: int, rng: np.random.Generator) -> list[np.ndarray]:
    """One candidate: for each year, the first positions of the blocks that fill it."""
    return [np.array([int(rng.integers(0, n)) for _ in range(-(-n // length))], np.int64) for n in sizes]


def positions(starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """Positions within a year: blocks from the starts that wrap around, cut to the year's size."""
    return ((starts[:, None] + np.arange(length)[None, :]) % size).ravel()[:size]


def block_indices(years: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    """Positions of one replication of dates in order, which never leave their year."""
    out, names = np.empty(len(years), np.int32), list(dict.fromkeys(np.asarray(years).tolist()))
    at = [np.nonzero(years == y)[0] for y in names]
    for own, starts in zip(at, block_starts([len(a) for a in at], length, rng)):
        out[own] = own[positions(starts, len(own), length)]
    return out


def _ranks(x: np.ndarray) -> np.ndarray:
    from .dependence import _average_ranks

    return _average_ranks(x)


def gap(values: np.ndarray, labels: np.ndarray) -> float:
    """Mean rank correlation within groups less that between them."""
    return _gaps(values, labels)[0]


def _gaps(values: np.ndarray, *labels: np.ndarray) -> list[float]:
    c = np.corrcoef(_ranks(values), rowvar=False)
    i, j = np.triu_indices(values.shape[1], 1)
    pairs, out = c[i, j], []
    for own in labels:
        within = own[i] == own[j]
        out.append(float(pairs[within].mean() - pairs[~within].mean()))
    return out


def paired_gap_bootstrap(panel: DataFrame, labels: DataFrame, replications: int, length: int = 20, level: float = 0.95, seed: int = SEED, chunks: int = 16) -> DataFrame:
    """One row: the clusters' gap and the given groups' gap, averaged over years, their difference, its bootstrap interval, and how many
    candidates were drawn and left out.

    panel (year, date, security, simple_return) holds each year's complete returns; labels (year, security, cluster, given)."""
    spark = panel.sparkSession
    rows = panel.select("year", F.to_date("date").alias("date"), "security", F.col("simple_return").cast("double").alias("simple_return"))
    sizes = rows.groupBy("year").agg(F.countDistinct("date").alias("days"), F.countDistinct("security").alias("n"), F.count("simple_return").alias("cells")).orderBy("year").collect()
    if not sizes or replications <= 0 or length <= 0 or any(r.days * r.n != r.cells for r in sizes):
        raise ValueError("a bootstrap needs years, each with every security's return on every day")
    require_none(rows.select("year", "security").distinct().join(labels, ["year", "security"], "left_anti"), "a security has no label")
    rng, digest = generator(seed, 1), hashlib.sha256()
    joined = rows.join(labels.select("year", "security", "cluster", "given"), ["year", "security"])
    spread = joined.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def each(key: tuple, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="security", values="simple_return").sort_index()
        named = pdf.groupby("security")[["cluster", "given"]].first().reindex(wide.columns)
        values, out = wide.to_numpy(float), []
        for candidate, starts in zip(own["candidate"], own["starts"]):
            sample = values if candidate < 0 else values[positions(np.asarray(starts), len(values), length)]
            flat = bool((np.ptp(sample, axis=0) == 0).any())
            cluster, given = (np.nan, np.nan) if flat else _gaps(sample, named["cluster"].to_numpy(), named["given"].to_numpy())
            out.append((int(candidate), flat, cluster, given))
        return pd.DataFrame(out, columns=["candidate", "flat", "cluster", "given"])

    def measured(first: int, count: int) -> DataFrame:
        drawn = [] if first else [(-1, int(r.year), 0, []) for r in sizes]
        for c in range(first, first + count):
            for r, starts in zip(sizes, block_starts([r.days for r in sizes], length, rng)):
                digest.update(starts.tobytes())
                drawn.append((c, int(r.year), c % chunks, starts.tolist()))
        table = spark.createDataFrame(drawn, "candidate long, year int, chunk int, starts array<long>")
        by_year = spread.groupBy("year", "chunk").cogroup(table.groupBy("year", "chunk")).applyInPandas(each, "candidate long, flat boolean, cluster double, given double")
        return by_year.groupBy("candidate").agg(F.bool_or("flat").alias("flat"), F.avg("cluster").alias("cluster"), F.avg("given").alias("given"))

    found: dict[int, tuple] = {}
    first, count = 0, replications + SPARE
    while True:
        for r in measured(first, count).collect():  # two numbers a candidate
            found[r.candidate] = (r.flat, r.cluster, r.given)
        first += count
        good = [c for c in range(first) if not found[c][0]][:replications]
        if len(good) == replications:
            break
        if first >= replications * MOST:
            raise RuntimeError("too many candidates are degenerate")
        count = replications
    _, cluster, given = found[-1]
    differences = np.array([found[c][1] - found[c][2] for c in good])
    low, high = np.quantile(differences, [(1 - level) / 2, (1 + level) / 2], method="linear")
    candidates = good[-1] + 1
    row = (
        float(cluster), float(given), float(cluster - given), replications, candidates, candidates - replications, float(low), float(high), float(np.mean([found[c][1] for c in good])), float(differences.mean()),
        float(differences.std(ddof=1)) if replications > 1 else None, "supported" if cluster > 0 and low > 0 else "not_supported", digest.hexdigest(),
    )
    return spark.createDataFrame(
        [row],
        "cluster_gap double, given_gap double, observed double, replications int, candidates int, rejected int, low double, high double, mean_cluster_gap double, mean_difference double, standard_error double, decision string, starts_sha256 string",
    )
