"""Bounded, repeatable samples of labelled rows, and the logistic regressions that are fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where nothing may be learned from the row; rows without an id count as held out."""
    return F.coalesce(id_remainder(doc_id, modulus) == remainder, F.lit(True))


def sample_of_classes(labels: DataFrame, label: str, modulus: int, remainder: int, bound: int) -> DataFrame:
    """(doc_id, y): of the rows that may be learned from, at most ``bound`` with label 1 and ``bound`` with label 0, by
    hash of the id. Null labels take no part; an id with both labels counts as 1."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), modulus, remainder))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for y in (1, 0)]
    return parts[0].unionByName(parts[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Newton's method on the weighted logistic loss with soft labels y and a ridge on all but nothing-free columns."""
    weight = np.ones(len(y)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ beta)
        gradient = x.T @ (weight * (p - y)) + ridge * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, gradient)
        beta -= step / max(1.0, float(np.abs(step).max()) / 4.0)
        if np.abs(step).max() < 1e-7:
            break
    return beta
