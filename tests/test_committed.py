"""The committed sink: whole or not there, in order, with damage found."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskloom.sources import committed

SCHEMA = "k long, name string, at timestamp, x double"


@pytest.fixture()
def rows(spark):
    return spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(997)).alias("k"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("n"), F.col("id"))).alias("name"), F.timestamp_seconds("id").alias("at"), (F.col("id") / 3).alias("x"))


def test_order_runs_through_all_parts(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    committed.write(rows, path, "k", "name")
    placed = committed.with_positions(spark, path, SCHEMA)
    found = [(r.k, r.name) for r in placed.orderBy("position").collect()]
    assert found == sorted([(r.k, r.name) for r in rows.collect()], key=lambda x: (x[0], x[1] is not None, x[1] or "")) and len(found) == 5000
    assert sorted(r.position for r in placed.collect()) == list(range(1, 5001))
    assert committed.out_of_order(placed, "position", "k", "name", block=64).isEmpty()
    swapped = placed.withColumn("k", F.when(F.col("position") == 129, -1).otherwise(F.col("k")))
    assert [r.position for r in committed.out_of_order(swapped, "position", "k", "name", block=64).collect()] == [129]
    assert sorted(map(tuple, committed.read(spark, path, SCHEMA).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_failed_run_leaves_the_version_before(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    committed.write(rows, path, "k")
    before = committed.read(spark, path, SCHEMA).count()
    broken = rows.repartition(4).withColumn("x", F.when(F.col("k") == 5, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception):
        committed.write(broken, path)
    assert committed.read(spark, path, SCHEMA).count() == before == 5000
    committed.vacuum(path)  # tasks that still ran when theirs failed may have written after the failed version was deleted
    assert len([p for p in Path(path).iterdir() if p.is_dir()]) == 1 and committed.read(spark, path, SCHEMA).count() == 5000
    committed.write(rows.limit(10), path, mode="append")
    assert committed.read(spark, path, SCHEMA).count() == 5010
    committed.write(rows.limit(3), path)
    assert committed.read(spark, path, SCHEMA).count() == 3


def test_parts_that_were_never_reported_are_no_rows(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    committed.write(rows, path)
    version = next(p for p in Path(path).iterdir() if p.is_dir())
    part = next(version.glob("*.parquet"))
    (version / "part-00099-speculative.parquet").write_bytes(part.read_bytes())
    assert committed.read(spark, path, SCHEMA).count() == 5000 and committed.damaged(spark, path).isEmpty()
    part.write_bytes(part.read_bytes() + b"x")
    lost = sorted(version.glob("part-0*-*.parquet"))[-2]
    lost_name, part_name = f"{version.name}/{lost.name}", f"{version.name}/{part.name}"
    if lost != part:
        lost.unlink()
    assert {(r.file, r.issue) for r in committed.damaged(spark, path).collect()} == {(part_name, "changed")} | ({(lost_name, "missing")} if lost != part else set())


def test_nothing_and_empty(spark, rows, tmp_path):
    with pytest.raises(committed.NotCommitted):
        committed.read(spark, str(tmp_path / "none"), SCHEMA)
    path = str(tmp_path / "empty")
    committed.write(rows.limit(0), path, "k")
    assert committed.read(spark, path, SCHEMA).count() == 0 and committed.with_positions(spark, path, SCHEMA).count() == 0
    assert json.loads((tmp_path / "empty" / committed.RECORD).read_text())["parts"] == []
