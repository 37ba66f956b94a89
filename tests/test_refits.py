"""Rolling refits over a stream: as the batch, restarted, with what comes too late refused and idle groups cleared."""

import datetime as dt

import pytest

from riskloom.streaming import refits

SCHEMA = "group_id string, ts timestamp, value double"
T0 = dt.datetime(2024, 1, 1)


def _rows(days, groups=("a", "b"), per_day=3):
    return [(g, T0 + dt.timedelta(days=d, hours=5 * k, minutes=len(g)), float((7 * d + 3 * k + ord(g)) % 11)) for d in days for g in groups for k in range(per_day)]


def _plain(df):
    return sorted((r.group_id, r.ts, r.value, r.kind, r.period, r.observations, round(r.mean, 9), round(r.sd, 9), None if r.residual is None else round(r.residual, 9)) for r in df.collect())


@pytest.fixture()
def streamed(spark, tmp_path):
    made = []

    def feed(rows):
        made.append(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(**options):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        refits.run_available(refits.rolling_refits(stream, "day", **options), str(tmp_path / "out"), str(tmp_path / "check"))
        return spark.read.schema(refits.OUT).parquet(str(tmp_path / "out"))

    return feed, run


def test_micro_batches_are_the_batch_and_go_on_after_a_restart(spark, streamed):
    feed, run = streamed
    options = {"history_days": 4, "least": 5}
    parts = [_rows(range(0, 3)), _rows(range(3, 7)), _rows(range(7, 8), per_day=2)]
    for part in parts[:2]:
        feed(part)
    run(**options)
    feed(parts[2])
    found = run(**options)  # a new query from the checkpoint of the first
    whole = refits.batch_refits(spark.createDataFrame([r for p in parts for r in p], SCHEMA), "day", **options)
    assert _plain(found) == _plain(whole) and found.where("residual IS NOT NULL").count() > 20


def test_rows_after_a_later_fit_are_refused_and_change_nothing(spark, streamed):
    feed, run = streamed
    options = {"history_days": 4, "least": 2, "delay": "20 days"}
    good, planted = _rows(range(0, 5), ("a",)), [("a", T0 + dt.timedelta(days=1, minutes=7), 1e6)]
    feed(good[:12])
    run(**options)
    feed(planted + good[12:] + [("a", None, 1.0), ("a", T0 + dt.timedelta(days=4, hours=9), None)])
    found = run(**options)
    assert _plain(found.where("kind = 'accepted'")) == _plain(refits.batch_refits(spark.createDataFrame(good, SCHEMA), "day", 4, 2))
    refused = found.where("kind = 'refused'").collect()
    assert [(r.value, r.period, r.residual) for r in refused] == [(1e6, T0 + dt.timedelta(days=3), None)]


def test_idle_groups_are_cleared(streamed):
    feed, run = streamed
    options = {"history_days": 2, "least": 2, "delay": "0 seconds"}
    for part in (_rows(range(0, 2), ("a", "b")), _rows(range(2, 9), ("b",)), _rows(range(9, 11), ("b",)), _rows([11], ("a",))):
        feed(part)
        found = run(**options)
    expired = [r.group_id for r in found.where("kind = 'expired'").collect()]
    again = found.where("group_id = 'a' AND kind = 'accepted' AND ts >= '2024-01-12'").collect()
    assert expired == ["a"] and len(again) == 3 and all(r.observations == 0 for r in again)


def test_months_and_what_is_refused(spark):
    us = refits.np.array(["2024-02-29T23:59:59", "2024-03-01"], "datetime64[us]").astype("int64")
    assert refits.period_start(us, "month").astype("datetime64[us]").astype(str).tolist() == ["2024-02-01T00:00:00.000000", "2024-03-01T00:00:00.000000"]
    with pytest.raises(ValueError):
        refits.rolling_refits(spark.createDataFrame([], SCHEMA), "year")
