"""Input verification and download clients: each rule is broken once; no request leaves."""

import datetime as dt
import gzip
import hashlib
import io
import json
from urllib.error import HTTPError
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from riskloom.sources import clients, files
from riskloom.sources import verification as ver

HEADER = "ticker,volume,open,close,high,low,window_start,transactions"
DAYS = ["2020-01-02", "2020-01-03"]


def line(ticker, day, n=1):
    stamp = int(dt.datetime.fromisoformat(f"{day}T05:00:00+00:00").timestamp()) * 10**9
    return f"{ticker},{n},1,1,1,1,{stamp},1"


def write_daily(root, day, lines, header=HEADER):
    path = root / f"market/day_aggs/{day[:4]}/{day[5:7]}/{day}.csv.gz"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress("\n".join([header, *lines, ""]).encode()))
    return {"date": day, "key": f"flat/day/{day[:4]}/{day[5:7]}/{day}.csv.gz", "local_path": path.relative_to(root).as_posix(), "size": path.stat().st_size, "row_count": len(lines), "sha256": hashlib.sha256(path.read_bytes()).hexdigest(), "etag": None, "columns": sorted(HEADER.split(",")), "status": "downloaded"}


def write_reference(root, ticker, kind, results, **changes):
    path = root / f"market/reference/{kind}/{ticker.replace('.', '_')}.json"
    files.write_json(path, {"schema_version": 1, "provider": "P", "ticker": ticker, "event_type": kind, "sample_start": "2020-01-01", "sample_end": "2020-12-31", "results": results} | changes)
    rows = len(results) if isinstance(results, list) else 0
    return {"ticker": ticker, "event_type": kind, "local_path": path.relative_to(root).as_posix(), "payload_bytes": path.stat().st_size, "rows": rows, "sha256": files.sha256(path), "schema_version": 1, "sample_start": "2020-01-01", "sample_end": "2020-12-31", "status": "existing"}


@pytest.fixture
def whole(tmp_path):
    daily = [write_daily(tmp_path, d, [line("A", d), line("B.C", d), line("Z", "2019-12-31")]) for d in DAYS]
    refs = [write_reference(tmp_path, t, k, [{ver.EVENT_DATES[k]: "2020-03-01"}, {ver.EVENT_DATES[k]: "2020-04-01"}]) for t in ("A", "B.C") for k in ver.EVENT_DATES]
    return tmp_path, {"schema_version": 2, "daily_files": daily, "daily_file_count": 2, "daily_compressed_bytes": sum(r["size"] for r in daily), "reference_downloads": refs, "reference_file_count": 4, "reference_status": "complete", "provider": "P"}


def verified(spark, root, manifest):
    sessions = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in DAYS], "date date")
    tickers = spark.createDataFrame([("A",), ("B.C",)], "ticker string")
    return ver.verify_inputs(spark, str(root), manifest, sessions, tickers, "flat/day", "market", "market/reference", "P", ("2020-01-01", "2020-12-31"), tickers)


def test_whole_inputs_pass_and_every_change_is_found(spark, whole):
    root, manifest = whole
    good = verified(spark, root, manifest)
    assert good == {"status": "pass", "errors": [], "verified_daily_files": 2, "verified_reference_files": 4}
    found = verified(spark, root, manifest | {"daily_file_count": 3, "daily_compressed_bytes": 1, "reference_status": "open", "reference_file_count": 9, "schema_version": 1, "daily_files": [*manifest["daily_files"], "x"]})
    assert {e["reason"] for e in found["errors"]} == {"daily_compressed_bytes_mismatch", "reference_status_not_complete", "reference_file_count_mismatch", "unsupported_schema_version", "record_not_object"}
    first = manifest["daily_files"][0]
    changed = [first | {"key": "x", "sha256": "0" * 64, "size": 1, "row_count": 9, "status": "?"}, manifest["daily_files"][1] | {"local_path": "market/none.csv.gz", "columns": None}, first | {"date": "2020-01-04"}]
    reasons = {(e["scope"], e["reason"]) for e in verified(spark, root, manifest | {"daily_files": changed, "daily_file_count": 3})["errors"]}
    assert {("daily:2020-01-02", r) for r in ("key_not_canonical", "sha256_differs", "size_differs", "row_count_differs", "invalid_status")} <= reasons
    assert {("daily:2020-01-03", r) for r in ("local_path_not_canonical", "file_absent", "missing_required_field")} <= reasons
    assert ("daily_calendar", "non_session_date:2020-01-04") in reasons and ("daily:2020-01-04", "modal_date_differs") in reasons
    refs = manifest["reference_downloads"]
    reasons = {(e["scope"], e["reason"]) for e in verified(spark, root, manifest | {"reference_downloads": [refs[0], refs[0], refs[1] | {"rows": 5}, refs[2] | {"ticker": "Q"}]})["errors"]}
    assert {("reference_manifest", r) for r in ("duplicate_identity:A:splits", "missing_record:B.C:splits", "missing_record:B.C:dividends", "unexpected_record:Q:splits")} <= reasons
    assert ("reference:A:dividends", "rows_differs") in reasons and {("reference:Q:splits", "identity_differs"), ("reference:Q:splits", "local_path_not_canonical")} <= reasons


@pytest.mark.parametrize(
    "lines,header,reason",
    [
        (["A,1,1"], HEADER, "row_with_wrong_fields"),
        ([line("A", "2020-01-02"), "A,1,1,1,1,1,soon,1"], HEADER, "invalid_window_start"),
        ([line("Q", "2020-01-05")] * 2 + [line("R", "2020-01-02")], HEADER, "modal_date_differs"),
        ([line("R", "2020-01-02")] * 2 + [line("A", "2020-01-05")], HEADER, "required_ticker_date_differs"),
        ([line("A", "2020-01-02") + ",9"], HEADER + ",extra", "unexpected_schema"),
        ([], HEADER, "no_data_rows"),
    ],
)
def test_contents_of_daily_files(spark, tmp_path, lines, header, reason):
    record = write_daily(tmp_path, "2020-01-02", lines, header)
    required = spark.createDataFrame([("A",)], "ticker string")
    assert reason in {r.reason for r in ver.daily_defects(spark, str(tmp_path), [record], "flat/day", "market", required).collect()}


@pytest.mark.parametrize(
    "results,changes,reason",
    [
        ([{"execution_date": "2020-04-01"}, {"execution_date": "2020-03-01"}], {}, "results_not_sorted"),
        ([{"execution_date": ""}], {}, "result_without_date"),
        ([{"execution_date": "soon"}], {}, "result_with_invalid_date"),
        ([{"execution_date": "2021-03-01"}], {}, "result_outside_sample"),
        ([], {"provider": "Q"}, "provider_differs"),
        ([], {"schema_version": 3}, "unsupported_schema"),
        ([], {"sample_end": "2021-01-01"}, "sample_differs"),
        (None, {}, "results_not_a_list"),
    ],
)
def test_contents_of_reference_documents(spark, tmp_path, results, changes, reason):
    record = write_reference(tmp_path, "A", "splits", results, **changes)
    found = {r.reason for r in ver.reference_defects(spark, str(tmp_path), [record], "market/reference", "P", ("2020-01-01", "2020-12-31")).collect()}
    assert reason in found


def test_upgrade_public_and_volatile(spark, whole):
    root, manifest = whole
    old = manifest | {"schema_version": 1, "daily_files": [{k: v for k, v in r.items() if k not in ("row_count", "columns")} for r in manifest["daily_files"]]}
    assert ver.upgraded_manifest(spark, str(root), old, "market/reference") == manifest and ver.upgraded_manifest(spark, str(root), manifest, "x") is manifest
    with pytest.raises(ValueError):
        ver.upgraded_manifest(spark, str(root), old | {"daily_files": [{"local_path": "market/none"}]}, "market/reference")
    public = ver.public_manifest(manifest | {"downloaded_at": "now"})
    assert "downloaded_at" not in public and "status" not in public["daily_files"][0] and public["verification_status"] == "pending_independent_verification"
    path = root / manifest["reference_downloads"][0]["local_path"]
    files.write_json(path, json.loads(path.read_text()) | {"downloaded_at": "now"})
    assert ver.without_volatile(str(root), manifest)["reference_downloads"] == manifest["reference_downloads"]


def test_primary_and_ancillary_rows(spark):
    daily = spark.createDataFrame([("A", dt.date(2020, 1, 2), 1.0), ("B", dt.date(2020, 1, 2), 2.0)], "ticker string, date date, close double")
    segments = spark.createDataFrame([("A", "X", dt.date(2020, 1, 1), dt.date(2020, 2, 1))], "ticker string, security string, start date, end date")
    primary, closes = ver.primary_and_ancillary(daily, segments, spark.createDataFrame([("B",)], "ticker string"))
    assert primary.first().security == "X" and primary.count() == 1 and closes.first().close == 2.0
    with pytest.raises(Exception):
        ver.primary_and_ancillary(daily.unionByName(daily), segments.limit(0), spark.createDataFrame([("B",)], "ticker string"))


def test_bound_table(spark, tmp_path):
    spark.createDataFrame([("M0", 1), ("M1", 2)], "model_id string, x int").coalesce(1).toPandas().to_parquet(tmp_path / "t.parquet")
    audit = {"status": "pass", "outputs": [{"path": "t.parquet", "sha256": files.sha256(tmp_path / "t.parquet")}]}
    assert ver.bound_table(spark, "t.parquet", audit, ["model_id", "x"], {"M0"}, str(tmp_path)).count() == 1
    for bad in (audit | {"status": "fail"}, audit | {"outputs": []}, {"status": "pass", "outputs": [{"path": "t.parquet", "sha256": "0"}]}):
        with pytest.raises(ValueError):
            ver.bound_table(spark, "t.parquet", bad, ["x"], None, str(tmp_path))
    with pytest.raises(ValueError):
        ver.bound_table(spark, "t.parquet", audit, ["x", "model_id"], {"M9"}, str(tmp_path))


HOSTS = {"api.example.com"}


class Server:
    def __init__(self, answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, url, headers):
        self.asked.append(url)
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return json.dumps(answer).encode()


def status(code):
    return HTTPError("https://api.example.com/x?apiKey=secret", code, "no", {}, io.BytesIO())


def test_retries_and_keys():
    waits = []
    server = Server([status(429), ConnectionError(), status(503), {"ok": 1}])
    assert clients.keyed_json("https://api.example.com/x?apikey=old&a=b", "secret", HOSTS, server, sleep=waits.append) == {"ok": 1}
    assert waits == [1.5, 3.0, 6.0] and parse_qs(urlsplit(server.asked[0]).query) == {"a": ["b"], "apiKey": ["secret"]}
    for answers in ([status(404)], [status(500)] * 7, [ConnectionError()] * 7):
        with pytest.raises(RuntimeError) as error:
            clients.keyed_json("https://api.example.com/x", "secret", HOSTS, Server(answers), sleep=waits.append)
        assert "secret" not in str(error.value)
    assert max(waits) == 30.0
    for url in ("http://api.example.com/x", "https://evil.example.com/x", "https://u@api.example.com/x", "https://api.example.com:444/x"):
        with pytest.raises(ValueError):
            clients.keyed_json(url, "secret", HOSTS, Server([{}]))
    with pytest.raises(ValueError):
        clients.store_endpoint("https://api.example.com/path", HOSTS)
    assert clients.store_endpoint("https://api.example.com/", HOSTS) == "https://api.example.com"


def test_pages_and_reference_documents(tmp_path):
    page = lambda n, following=None: {"results": [{"execution_date": f"2020-0{n}-01"}]} | ({"next_url": following} if following else {})
    arguments = {"root": str(tmp_path), "folder": "ref", "base": "https://api.example.com", "key": "k", "hosts": HOSTS, "provider": "P", "start": "2020-01-01", "end": "2020-12-31"}
    server = Server([page(1, "https://api.example.com/next?cursor=c"), page(2)])
    record = clients.download_reference(kind="splits", ticker="B.C", get=server, **arguments)
    assert (record["rows"], record["status"], record["local_path"]) == (2, "downloaded", "ref/splits/B_C.json") and record["request"]["parameters"]["execution_date.gte"] == "2020-01-01"
    assert clients.download_reference(kind="splits", ticker="B.C", get=Server([]), **arguments)["status"] == "existing"
    for answers in ([{"results": "x"}], [{"results": [{}]}], [page(1, "https://evil.example.com/x")]):
        with pytest.raises((RuntimeError, ValueError)):
            clients.download_reference(kind="splits", ticker="D", get=Server(answers), **arguments)
    made = clients.download_references(["A", "A"], get=Server([page(1), {"results": []}]), **arguments)
    assert [(r["ticker"], r["event_type"], r["rows"]) for r in made] == [("A", "splits", 1), ("A", "dividends", 0)]


class Store:
    def __init__(self, objects):
        self.objects, self.loads = objects, 0

    def get_paginator(self, name):
        return self

    def paginate(self, Bucket, Prefix):
        yield {"Contents": [{"Key": k, "Size": len(v), "ETag": '"e"'} for k, v in self.objects.items() if k.startswith(Prefix)]}
        yield {}

    def download_file(self, bucket, key, path):
        self.loads += 1
        with open(path, "wb") as f:
            f.write(self.objects[key])


def test_objects_are_listed_and_downloaded_once(tmp_path):
    body = lambda d: gzip.compress(f"{HEADER}\n{line('A', d)}\n".encode())
    store = Store({f"flat/{d[:4]}/{d[5:7]}/{d}.csv.gz": body(d) for d in ("2019-12-31", "2020-01-02", "2020-01-03")})
    items = clients.listed_objects(store, "b", "flat", "2020-01-01", "2020-12-31")
    assert [i["date"] for i in items] == ["2020-01-02", "2020-01-03"] and items[0]["etag"] == "e"
    for loads, state in ((2, "downloaded"), (2, "existing")):
        made = clients.download_objects(store, "b", str(tmp_path), "market", items, 2, str(tmp_path / "c.json"))
        assert store.loads == loads and {r["status"] for r in made} == {state} and [r["row_count"] for r in made] == [1, 1]
    assert len(json.loads((tmp_path / "c.json").read_text())["daily_files"]) == 2
    bad = Store({"flat/2020/01/2020-01-04.csv.gz": gzip.compress(b"a,b\n1,2\n")})
    with pytest.raises(RuntimeError):
        clients.download_object(bad, "b", str(tmp_path), "market", clients.listed_objects(bad, "b", "flat", "2020-01-01", "2020-12-31")[0])
    assert not list(tmp_path.rglob("*2020-01-04*"))
    with pytest.raises(ValueError):
        clients.listed_objects(Store({"flat/2020/a-2020-01-02": b"", "flat/2020/b-2020-01-02": b""}), "b", "flat", "2020-01-01", "2020-12-31")


def test_cross_check_of_a_universe(tmp_path):
    stamp = int(dt.datetime(2020, 1, 2, 14, 30, tzinfo=dt.UTC).timestamp())
    chart = {"chart": {"result": [{"meta": {"symbol": "BRK-B", "currency": "USD", "firstTradeDate": 0}, "timestamp": [stamp - 86400, stamp], "indicators": {"quote": [{"close": [1.0, 2.0]}], "adjclose": [{"adjclose": [0.5, 1.5]}]}}]}}
    arguments = {"raw": str(tmp_path), "search": "https://api.example.com/s", "chart": "https://api.example.com/c", "hosts": HOSTS, "day": "2020-01-02", "aliases": {"BRK.B": "BRK-B"}, "limitations": ["current"], "sleep": lambda s: None}
    server = Server([{"quotes": [{"symbol": "OTHER"}]}, {"quotes": [{"symbol": "brk-b", "longname": "Berkshire"}]}, chart])
    rows, manifest = clients.universe_reference([{"ticker": "BRK.B", "company_name": "Berkshire"}], get=server, **arguments)
    assert (rows[0]["close"], rows[0]["adjusted_close"], rows[0]["metadata_status"], rows[0]["price_status"]) == (2.0, 1.5, "found_current_search", "found")
    assert rows[0]["limitations"] == "current; symbol alias applied: BRK.B->BRK-B" and manifest["errors"] == []
    again, _ = clients.universe_reference([{"ticker": "BRK.B", "company_name": "Berkshire"}], get=Server([]), **arguments)
    assert again == rows  # from the cache
    rows, manifest = clients.universe_reference([{"ticker": "GONE", "company_name": "G"}], get=Server([status(404)] * 3), **arguments)
    assert rows[0]["metadata_status"] == "not_found_or_inactive" and rows[0]["price_status"] == "not_found" and "HTTP 404" in manifest["errors"][0]["error"]
