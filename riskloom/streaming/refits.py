"""Rolling refits over a stream: a group's model is fitted at the start of each period, on what was known then.

State of a group: the rows of its history (list), how many rows of each period came too late (map), the model in force and the latest row
(value). The first row of a period, or a later one, fits the model of that period from the history before it; what then arrives for earlier periods is
refused, as a published fit never changes. History older than its span goes with each fit, and an event-time timer clears a group that has
been idle for that long. (Expiry by processing time, which the state store offers, would make results hang on when a job runs.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "group_id string, ts timestamp, value double, kind string, period timestamp, observations long, mean double, sd double, residual double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACCEPTED, REFUSED, EXPIRED = "accepted", "refused", "expired"
_DAY = 86_400_000_000


def period_start(us: np.ndarray, period: str) -> np.ndarray:
    """Microseconds of the start of the day or month, in UTC, that each moment lies in."""
    moments = us.astype("datetime64[us]")
    return moments.astype("datetime64[D]" if period == "day" else "datetime64[M]").astype("datetime64[us]").astype(np.int64)


class RollingFit(StatefulProcessor):
    def __init__(self, period: str, history_days: int, least: int) -> None:
        self.period, self.span, self.least = period, history_days * _DAY, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getListState("history", "us long, value double")
        self.late = handle.getMapState("late", "period long", "n long")
        self.model = handle.getValueState("model", "period long, observations long, mean double, sd double, latest long")

    def _rows(self, key: tuple, kind: str, us, values, models) -> pd.DataFrame:
        start, n, mean, sd = (np.array(x) for x in zip(*models)) if len(models) else ((),) * 4
        sd, values = np.array(sd, float), np.array(values, float)
        usable = (np.array(n) >= self.least) & (sd > 0) & (kind == ACCEPTED)
        residual = np.where(usable, (values - np.array(mean, float)) / np.where(sd > 0, sd, 1.0), np.nan)
        out = pd.DataFrame({"group_id": key[0], "ts": np.array(us, "datetime64[us]"), "value": values, "kind": kind, "period": np.array(start, "datetime64[us]"), "observations": np.array(n, np.int64), "mean": np.array(mean, float), "sd": sd})
        return out.assign(residual=pd.Series(residual, dtype=object).where(usable, None))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        us, values = pdf["ts"].astype("datetime64[us]").to_numpy().astype(np.int64), pdf["value"].to_numpy(float)
        order = np.lexsort((values, us))
        us, values = us[order], values[order]
        starts = period_start(us, self.period)
        start, n, mean, sd, latest = self.model.get() if self.model.exists() else (None, 0, 0.0, 0.0, None)
        late = starts < (start if start is not None else starts.min())
        if late.any():
            for period, count in zip(*np.unique(starts[late], return_counts=True)):
                before = self.late.getValue((int(period),))[0] if self.late.containsKey((int(period),)) else 0
                self.late.updateValue((int(period),), (before + int(count),))
            yield self._rows(key, REFUSED, us[late], values[late], [(start, n, mean, sd)] * int(late.sum()))
        us, values, starts = us[~late], values[~late], starts[~late]
        if not len(us):
            return
        models, known = [], None
        for period in np.unique(starts):
            if start is None or period > start:
                if known is None:  # the history is read where a fit needs it, once a batch
                    held = list(self.history.get())
                    known = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], float)
                every = np.concatenate([known[0], us]), np.concatenate([known[1], values])
                inside = every[1][(every[0] >= period - self.span) & (every[0] < period)]
                start, n = int(period), len(inside)
                mean, sd = (float(inside.mean()), float(inside.std())) if n else (0.0, 0.0)
            models += [(start, n, mean, sd)] * int((starts == period).sum())
        if known is None:
            self.history.appendList([(int(a), float(b)) for a, b in zip(us, values)])
        else:
            every = np.concatenate([known[0], us]), np.concatenate([known[1], values])
            kept = every[0] >= start - self.span
            self.history.put([(int(a), float(b)) for a, b in zip(every[0][kept], every[1][kept])])
        ends = lambda last: int((last + self.span) // 1000) + 1
        newest = max(int(us[-1]), latest or 0)
        if latest is not None and newest != latest:
            self.handle.deleteTimer(ends(latest))
        self.handle.registerTimer(ends(newest))
        self.model.update((start, n, mean, sd, newest))
        yield self._rows(key, ACCEPTED, us, values, models)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.model.exists():
            return
        start, n, mean, sd, latest = self.model.get()
        for state in (self.history, self.late, self.model):
            state.clear()
        yield self._rows(key, EXPIRED, [latest], [np.nan], [(start, n, mean, sd)])

    def close(self) -> None:
        pass


def _known(rows: DataFrame) -> DataFrame:
    typed = rows.select(F.col("group_id").cast("string").alias("group_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    return typed.where("ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")


def rolling_refits(stream: DataFrame, period: str = "month", history_days: int = 1096, least: int = 700, delay: str = "1 day") -> DataFrame:
    """stream (group_id, ts, value) -> every row with the model of its period: the mean and standard deviation of the group's values in
    the ``history_days`` before the period, how many there are, and, from ``least`` on, the standardised residual. kind: accepted, refused
    (it came after a later period's fit, whose model it shows, and is in no fit) or expired (a group idle for that long, whose state is gone).
    Null values and times take no part; rows later than the watermark's ``delay`` are dropped by the engine. Needs the RocksDB state store."""
    if period not in ("day", "month"):
        raise ValueError("a period is a day or a month")
    known = _known(stream).withWatermark("ts", delay)
    grouped = known.groupBy("group_id")
    return grouped.transformWithStateInPandas(RollingFit(period, history_days, least), OUT, "Append", "EventTime")


def run_available(stream: DataFrame, path: str, checkpoint: str, session: SparkSession | None = None) -> None:
    """Runs a stream over all that there is now, in as many batches as its source makes, and writes Parquet; a run after a failure goes on
    from the checkpoint."""
    spark = session or stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def batch_refits(rows: DataFrame, period: str = "month", history_days: int = 1096, least: int = 700) -> DataFrame:
    """What ``rolling_refits`` gives for rows that come in order, without a stream."""
    known = _known(rows).withColumn("period", F.date_trunc(period, "ts"))
    periods = known.select("group_id", "period").distinct()
    # a value goes to the periods whose history it can lie in: days after its own, up to the span
    day = F.to_date("ts")
    far = known.select("group_id", F.col("ts").alias("of"), "value", F.explode(F.sequence(day, F.date_add(day, history_days + 1))).alias("day")).withColumn("period", F.col("day").cast("timestamp")).drop("day")
    inside = far.join(periods, ["group_id", "period"]).where((F.col("of") < F.col("period")) & (F.col("of") >= F.col("period") - F.expr(f"INTERVAL '{history_days}' DAY")))
    fits = inside.groupBy("group_id", "period").agg(F.count("*").alias("observations"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    joined = known.join(fits, ["group_id", "period"], "left").na.fill({"observations": 0, "mean": 0.0, "sd": 0.0})
    residual = F.when((F.col("observations") >= least) & (F.col("sd") > 0), (F.col("value") - F.col("mean")) / F.col("sd"))
    return joined.select("group_id", "ts", "value", F.lit(ACCEPTED).alias("kind"), "period", "observations", "mean", "sd", residual.alias("residual"))
