"""Documents as data: label maps, file records, lineage and gates, against plain versions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators import documents as doc
from riskloom.operators import groupings as gr
from riskloom.plans import gates, records

LABELS = "book string, year int, security string, group_id string"
RUN = "run long, universe string, model string, amendment string, reference string, n_rows long, current_sha256 string"
ODD = ["A", "b c", 'quote " and \\ slash', "tab\tnew\nline\x01\x1f\x7f", "Ä", "日本", "😀", "/", "", "ﬀ", "~"]


def _digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_label_documents_are_canonical_json(spark):
    rows = [(book, year, name, f"g {k} {name}") for book in ("x", "y") for year in (2020, 999) for k, name in enumerate(ODD)]
    labels = spark.createDataFrame(rows, LABELS)
    found = {r.book: r for r in doc.label_documents(labels, "book").collect()}
    for book in ("x", "y"):
        plain = {str(y): {s: g for b, yy, s, g in rows if b == book and yy == y} for y in (2020, 999)}
        assert found[book].body == json.dumps(plain, sort_keys=True, separators=(",", ":")) and found[book].sha256 == _digest(found[book].body)
        own = doc.label_maps(labels.where(f"book = '{book}'")).collect()
        assert {(r.year, r.members, r.sha256) for r in own} == {(int(y), len(ODD), gr.label_map_sha256(m)) for y, m in plain.items()}
    back = doc.label_rows(doc.label_documents(labels, "book"), "book")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert doc.label_documents(labels.limit(0), "book").collect() == []
    assert doc.label_documents(labels.limit(0)).collect() == []


@pytest.mark.parametrize("bad", [("x", 2020, "A", "other"), ("x", 2020, None, "g"), ("x", 2020, "B", None)])
def test_labels_that_are_no_map_fail(spark, bad):
    labels = spark.createDataFrame([("x", 2020, "A", "g"), bad], LABELS)
    with pytest.raises(Exception, match="missing or repeated in 2020"):
        doc.label_documents(labels, "book").collect()


@pytest.mark.parametrize("body", ["[1]", "{", None, '{"2020": 3}', '{"twenty": {"A": "g"}}'])
def test_bodies_that_are_no_label_documents_fail(spark, body):
    with pytest.raises(Exception):
        doc.label_rows(spark.createDataFrame([(body,)], "body string")).collect()


def _plain(node, place="$"):
    own = [(place, *[node[k] if isinstance(node[k], str) else None for k in ("path", "sha256")])] if isinstance(node, dict) and "path" in node and "sha256" in node else []
    inside = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
    return own + [x for k, child in inside for x in _plain(child, f"{place}.{k}" if isinstance(node, dict) else f"{place}[{k}]")]


DEEP = {"path": "deep", "sha256": "d" * 64}
for _ in range(4):
    DEEP = {"in": [DEEP]}
BODIES = [
    {"path": "top", "sha256": "a" * 64, "in": {"path": "a/b", "sha256": "b" * 64}},
    [{"path": "x", "sha256": "c" * 64}, [{"path": "../x", "sha256": "c" * 64}], 3, None, "path"],
    {"path": 5, "sha256": "a" * 64, "more": {"path": None, "sha256": "x"}, "some": {"path": "only"}},
    {"a": {"path": "/abs", "sha256": "a" * 64}, "b": {"path": "a/../../b", "sha256": "a" * 64}, "c": {"path": "gen/one", "sha256": "a" * 64}, "d": {"path": "", "sha256": "a" * 64}},
    {"xpath": "x", "mysha256": "y", "in": {"xpath": {"path": "p"}, "sha256": "y"}},
    DEEP, {}, [], 3, "text",
]


def test_records_are_found_at_any_depth(spark):
    documents = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(BODIES)] + [(99, None)], "document long, body string")
    records = doc.hash_records(documents)
    assert sorted(map(tuple, records.collect()), key=str) == sorted(((k, *x) for k, b in enumerate(BODIES) for x in _plain(b)), key=str)
    files = spark.createDataFrame([("top", "a" * 64), ("a/b", "0" * 64), ("x", "c" * 64), ("deep", "d" * 64)], "path string, sha256 string")
    status = {(r.document, r.place): r.status for r in doc.hash_status(records, files).collect()}
    assert status[0, "$"] == status[1, "$[0]"] == "current" and status[0, "$.in"] == "stale" and status[1, "$[1][0]"] == "outside"
    assert [status[3, f"$.{x}"] for x in "abcd"] == ["outside", "outside", "missing", "malformed"] and status[2, "$"] == "malformed"
    lineage = {r.document: r for r in doc.lineage(documents, files, ("gen",)).collect()}
    assert lineage[5].status == "pass" and lineage[5].records == 1 and lineage[6].status == lineage[99].status == "fail" and lineage[0].stale == 1
    only = doc.lineage(spark.createDataFrame([(1, json.dumps({"path": "gen/one", "sha256": "a" * 64}))], "document long, body string"), files, ("gen/",)).first()
    assert only.only_generated_missing and only.missing == 1 and only.status == "fail" and not lineage[3].only_generated_missing
    with pytest.raises(Exception):
        doc.hash_records(spark.createDataFrame([(1, "{")], "document long, body string")).collect()


def test_facts_hang_on_each_other(spark):
    facts = spark.createDataFrame([(run, f, f not in broken) for run, broken in ((1, ""), (2, "a"), (3, "bd"), (4, "ac")) for f in "abcde"], "run long, fact string, holds boolean")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("e", "c"), ("e", "d"), ("e", "d")], "fact string, needs string")
    found = {(r.run, r.fact): (r.asked, r.causes) for r in doc.blocked(facts, needs).collect()}
    assert len(found) == 20 and all(found[1, f] == (True, []) for f in "abcde")
    assert found[2, "a"] == (True, ["a"]) and all(found[2, f] == (False, ["a"]) for f in "bcde")
    assert found[3, "a"] == (True, []) and found[3, "b"] == (True, ["b"]) and found[3, "d"] == (False, ["b"]) and found[4, "e"] == (False, ["a"])
    with pytest.raises(Exception):
        doc.blocked(facts, spark.createDataFrame([("a", "b"), ("b", "a")], "fact string, needs string"), 4).collect()
    with pytest.raises(Exception, match="unknown"):
        doc.blocked(spark.createDataFrame([(1, "a", None)], "run long, fact string, holds boolean"), needs).collect()


UNIVERSE = {"status": "blocked", "blockers": [gates.WAIVED], "public_universe_sha256": "u", "source_manifest_sha256": "m"}
MODEL = {
    "provenance": {"amendment_id": "PA", "reporting_scope": gates.PROVISIONAL, "allow_modelling_with_provisional_universe": True, "licensed_provenance_claim_allowed": False, "amended_universe_provenance_status": "amended"},
    "quality_gates": {"allow_provisional_universe_provenance": True}, "protocol_status": gates.FROZEN_STATUS,
}
AMENDMENT = {
    "status": "active", "amendment_id": "PA", "modelling_allowed": True, "licensed_provenance_claim_allowed": False, "reporting_scope": gates.PROVISIONAL, "expected_public_universe_sha256": "u",
    "expected_universe_source_manifest_sha256": "m", "minimum_metadata_matches": 9, "minimum_price_matches": 9, "accepted_missing_tickers": ["Z"], "amended_universe_provenance_status": "amended",
}
REFERENCE = {"status": "provisional_non_licensed", "row_count": 10, "metadata_found_count": 9, "price_found_count": 9, "request_failures": [{"ticker": "Z"}], "gate_eligibility": {"foundation_v2_universe_provenance": False}, "output_sha256": "o"}
#: What breaks each rule: the document, the field, and the value.
BREAKS = {
    "generic_failed_provenance_waiver_forbidden": ("model", "quality_gates.allow_failed_universe_provenance", True),
    "model_config_must_forbid_licensed_claim": ("model", "provenance.licensed_provenance_claim_allowed", True),
    "model_config_provisional_modelling_disabled": ("model", "provenance.allow_modelling_with_provisional_universe", None),
    "model_config_reporting_scope_mismatch": ("model", "provenance.reporting_scope", "confirmatory"),
    "provisional_amendment_does_not_allow_modelling": ("amendment", "modelling_allowed", False),
    "provisional_amendment_id_mismatch": ("amendment", "amendment_id", "X"),
    "provisional_amendment_must_forbid_licensed_claim": ("amendment", "licensed_provenance_claim_allowed", "no"),
    "provisional_amendment_not_active": ("amendment", "status", "draft"),
    "provisional_amendment_source_manifest_hash_mismatch": ("amendment", "expected_universe_source_manifest_sha256", "x"),
    "provisional_amendment_status_invalid": ("amendment", "amended_universe_provenance_status", "x"),
    "provisional_amendment_universe_hash_mismatch": ("universe", "public_universe_sha256", "x"),
    "quality_gate_provisional_provenance_disabled": ("model", "quality_gates.allow_provisional_universe_provenance", False),
    "reference_file_hash_mismatch": ("reference", "output_sha256", "x"),
    "reference_metadata_coverage_below_amendment_minimum": ("reference", "metadata_found_count", 8),
    "reference_missing_tickers_differ_from_amendment": ("reference", "request_failures", []),
    "reference_must_remain_nonlicensed": ("reference", "gate_eligibility.foundation_v2_universe_provenance", True),
    "reference_price_coverage_below_amendment_minimum": ("amendment", "minimum_price_matches", None),
    "reference_row_count_invalid": ("reference", "row_count", 9),
    "reference_status_invalid": ("reference", "status", "licensed"),
    "universe_has_nonwaivable_provenance_issue": ("universe", "blockers", [gates.WAIVED, "other"]),
}


def _run(n, **changed):
    parts = json.loads(json.dumps({"universe": UNIVERSE, "model": MODEL, "amendment": AMENDMENT, "reference": REFERENCE}))
    for name, (path, value) in changed.items():
        *way, last = path.split(".")
        at = parts[name]
        for key in way:
            at = at[key]
        at[last] = value
    return (n, *[json.dumps(x) for x in parts.values()], 10, "o")


def test_every_rule_of_an_amendment_can_break(spark):
    rows = [_run(k, **{name: (path, value)}) for k, (name, path, value) in enumerate(BREAKS.values())]
    rows += [_run(100), (101, *rows[0][1:3], None, rows[0][4], 10, "o"), (102, *rows[0][1:4], None, 10, "o"), _run(103, amendment=("reporting_scope", "confirmatory"))]
    found = {r.run: r.issues for r in gates.amendment_issues(spark.createDataFrame(rows, RUN)).collect()}
    assert [found[k] for k in range(len(BREAKS))] == [[code] for code in BREAKS]
    assert found[100] == [] and found[101] == ["provisional_amendment_absent"] and found[102] == ["reference_manifest_absent"]
    assert set(gates.RULES) == set(BREAKS) | {"provisional_reporting_scope_invalid"} and found[103] == ["model_config_reporting_scope_mismatch", "provisional_reporting_scope_invalid"]


def test_foundation_gate_of_many_runs(spark):
    names = [x for x in gates.CODES if x not in ("universe_accepted", "method_frozen")]
    rows = [_run(0), _run(1, universe=("status", "pass")), _run(2, amendment=("status", "draft")), _run(3, model=("protocol_status", "open")), *[_run(10 + k) for k in range(len(names))], _run(40), _run(41, universe=("blockers", None), amendment=("status", "x"))]
    facts = [(r[0], name, r[0] != 10 + k and r[0] != 40) for r in rows for k, name in enumerate(names)]
    found = {r.run: r for r in gates.foundation_status(spark.createDataFrame(rows, RUN), spark.createDataFrame(facts, "run long, fact string, holds boolean")).collect()}
    assert (found[0].status, found[0].blockers, found[0].reporting_scope, found[0].readiness) == ("provisional_pass", [], gates.PROVISIONAL, "pass_provisional")
    assert (found[1].status, found[1].reporting_scope, found[1].readiness) == ("pass", gates.CONFIRMATORY, "pass")
    assert found[2].blockers == sorted([gates.WAIVED, "provisional_amendment_not_active"]) and found[3].blockers == ["method_freeze_not_passed"]
    assert [found[10 + k].blockers for k in range(len(names))] == [[gates.CODES[x]] for x in names]
    roots = [x for x in names if not gates.NEEDS.get(x) or gates.NEEDS[x] == ("universe_accepted",)]
    assert found[40].blockers == sorted(gates.CODES[x] for x in roots) and found[41].status == "blocked" and gates.CODES["universe_accepted"] in found[41].blockers


def test_file_facts(spark):
    body = lambda path, digest: json.dumps({"outputs": [{"path": path, "sha256": digest}]})
    documents = spark.createDataFrame([(1, "universe", body("a", "a" * 64)), (2, "universe", body("a", "b" * 64)), (1, "arithmetic", "{}"), (1, "notes", body("a", "a" * 64))], "run long, kind string, body string")
    found = {(r.run, r.fact): r.holds for r in gates.file_facts(documents, spark.createDataFrame([("a", "a" * 64)], "path string, sha256 string")).collect()}
    assert found == {(1, "universe_files_current"): True, (2, "universe_files_current"): False, (1, "arithmetic_files_current"): False}


def test_foundation_gate_broadcasts_no_run_however_small_it_looks(spark, tmp_path):
    """Keys pack so well that Spark takes what is made of them for small: no join may hang on that."""
    path = str(tmp_path / "customer.parquet")
    spark.range(20_000).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("m").alias("c_mktsegment")).coalesce(1).write.parquet(path)
    size = sum(x.stat().st_size for x in (tmp_path / "customer.parquet").glob("*.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(size * 5 // 2))
    try:
        plan = records.foundation_status(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    files = spark.createDataFrame([("a", "a" * 64)], "path string, sha256 string")
    checked = doc.hash_status(spark.createDataFrame([(1, "$", "a", "a" * 64), (1, "$", "b", "a" * 64)], "document long, place string, path string, sha256 string"), files)
    assert "SortMergeJoin" in checked._jdf.queryExecution().executedPlan().toString() and {(r.path, r.status) for r in checked.collect()} == {("a", "current"), ("b", "missing")}


def test_runs_without_a_name_take_no_part(spark):
    rows = [_run(0), (None, *_run(0)[1:])]
    assert [r.run for r in gates.foundation_status(spark.createDataFrame(rows, RUN), spark.createDataFrame([], "run long, fact string, holds boolean")).collect()] == [0]
