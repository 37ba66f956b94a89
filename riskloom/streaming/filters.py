"""Streaming forms of the daily filter and of duplicate rejection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FILTERED = "group_id string, ts timestamp, value double, mean double, variance double, residual double"


def variance_filter(stream: DataFrame, smoothing: float = 0.94, start_variance: float = 1.0) -> DataFrame:
    """(group_id, ts, value) -> each value with the mean and smoothed variance known before it. State: count, mean, variance.
    Values of one batch are taken in order of time; what is late for the watermark is dropped by it."""

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, mean, variance = state.get if state.exists else (0, 0.0, start_variance)
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        means, variances = [], []
        for value in pdf["value"].tolist():  # a recursion: each value is filtered with what was known before it
            means.append(mean)
            variances.append(variance)
            error = value - mean
            count += 1
            mean += error / count
            variance = smoothing * variance + (1 - smoothing) * error * error
        state.update((count, float(mean), float(variance)))
        out = pd.DataFrame({"group_id": key[0], "ts": pdf["ts"].to_numpy(), "value": pdf["value"].to_numpy(float), "mean": means, "variance": variances})
        yield out.assign(residual=(out["value"] - out["mean"]) / out["variance"] ** 0.5)

    return stream.groupBy("group_id").applyInPandasWithState(each, FILTERED, "count long, mean double, variance double", "append", GroupStateTimeout.NoTimeout)


def without_repeats(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def daily_totals(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tumbling day windows by group, closed by the watermark."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "group_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
