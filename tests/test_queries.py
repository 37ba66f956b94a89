"""Registered queries against their DuckDB SQL on the smallest tables, and sources and sinks."""

import gzip
import json
import math

import duckdb
import pytest

from riskloom.plans import registry, stages
from riskloom.sources import files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(rows):
    def cell(x):
        return "None" if x is None or (isinstance(x, float) and math.isnan(x)) else repr(x + 0.0) if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


#: Parts of names of queries that need more days than the smallest tables have.
LONGER = ("rolling", "daily_scores", "risk_model", "coverage", "transitions", "calibration", "diebold", "holm", "best_model", "accuracy", "summaries", "hypothesis", "log_scores", "forecast", "annual_", "refit_tasks")


@pytest.fixture(scope="module")
def duck(small):
    def connected(folder):
        c = duckdb.connect()
        for t in TABLES:
            c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
        return c

    return {folder: connected(folder) for folder in (small, "/root/testdata/sf0.01")}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, small, duck, name):
    folder = "/root/testdata/sf0.01" if any(x in name for x in LONGER) else small
    df = registry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    expected = duck[folder].sql(registry.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    found = _plain(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert found == _plain(expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert found or folder == small


def test_daily_files_and_event_documents(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("ticker,volume,open,close,high,low,window_start,transactions\nABC,1,10,10,10,10,1577941200000000000,1\n")
    daily = files.daily_files(spark, [str(tmp_path / "a.csv.gz")])
    assert str(daily.first().date) == "2020-01-02"
    assert files.file_dates(daily).first().off_date_rows == 0
    (tmp_path / "e.json").write_text(json.dumps({"ticker": "ABC", "event_type": "splits", "results": [{"execution_date": "2020-01-03", "split_from": 1, "split_to": 2}]}))
    event = files.event_documents(spark, [str(tmp_path / "e.json")]).first()
    assert event.factor == 2.0 and event.event_id == "e.json:0"


def test_sinks_and_gates(spark, tmp_path):
    files.write_json(tmp_path / "x.json", {"b": 1, "a": {"path": "t.txt", "sha256": "0" * 64}})
    assert files.stale_artifacts(files.load_json(tmp_path / "x.json"), tmp_path) == ["t.txt: missing"]
    with pytest.raises(ValueError):
        files.write_json(tmp_path / "x.json", float("nan"))
    with pytest.raises(ValueError):
        files.safe_path(tmp_path, "../y")
    files.write_csv(tmp_path / "x.csv", [{"a": None, "b": True, "c": 0.1 + 0.2}], ["a", "b", "c"])
    assert (tmp_path / "x.csv").read_text() == "a,b,c\n,true,0.3\n"
    for _ in range(2):
        files.write_parquet(spark.range(3), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3 and len(list(tmp_path.glob("p*"))) == 1
    ran = []
    steps = [stages.Stage(n, lambda n=n: ran.append(n)) for n in "abc"]
    stages.run(stages.select(steps, "b"))
    assert ran == ["b", "c"] and stages.gate({"x": True, "y": False}, {"y"}) == ("provisional_pass", ["y"])
