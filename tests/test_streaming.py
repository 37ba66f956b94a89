"""Streams against plain recursions and batch results."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.streaming import filters

SCHEMA = "group_id string, ts timestamp, value double"


def run(spark, tmp_path, batches, plan, mode="append"):
    """Feeds files one by one and gives all that came out."""
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"part={k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source / "part=*"))
    name = f"out_{tmp_path.name}".replace("-", "_")
    query = plan(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return spark.table(name).collect()


def at(minute):
    return dt.datetime(2020, 1, 1) + dt.timedelta(minutes=minute)


def test_filter_keeps_its_state_between_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = rng.standard_normal(30).tolist()
    batches = [[(g, at(10 * b + i), values[10 * b + i] * (2 if g == "b" else 1)) for i in reversed(range(10)) for g in "ab"] for b in range(3)]
    found = run(spark, tmp_path, batches, lambda s: filters.variance_filter(s, 0.9, 0.5))
    assert len(found) == 60
    for g, scale in (("a", 1), ("b", 2)):
        mean, variance = 0.0, 0.5
        for n, r in enumerate(sorted((r for r in found if r.group_id == g), key=lambda r: r.ts)):
            assert (r.mean, r.variance) == (pytest.approx(mean), pytest.approx(variance)) and r.residual == pytest.approx((r.value - mean) / variance**0.5)
            error = values[n] * scale - mean
            mean += error / (n + 1)
            variance = 0.9 * variance + 0.1 * error * error


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    batches = [[("a", at(0), 1.0), ("a", at(0), 1.0), ("b", at(1), 2.0)], [("a", at(0), 1.0), ("c", at(2), 3.0)]]
    found = run(spark, tmp_path, batches, lambda s: filters.without_repeats(s, ["group_id"]))
    assert sorted(r.group_id for r in found) == ["a", "b", "c"]


def test_days_are_closed_by_the_watermark(spark, tmp_path):
    day = 24 * 60
    batches = [[("a", at(0), 1.0), ("a", at(5), 3.0)], [("a", at(3 * day), 9.0)], [("a", at(6 * day), 9.0)]]
    found = run(spark, tmp_path, batches, lambda s: filters.daily_totals(s).select(F.col("window.start").alias("day"), "group_id", "n", "mean"))
    assert (found[0].n, found[0].mean) == (2, 2.0) and all(r.day < at(6 * day) for r in found)
