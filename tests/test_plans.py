"""Protocols, lineage, gates and reports: every rule holds on the frozen documents and is broken once."""

import copy
import json
import re

import pytest

from riskloom.plans import lineage, protocol, reports
from riskloom.operators.quality import ConstraintError
from riskloom.sources import files


def edited(config, path, value):
    out = copy.deepcopy(config)
    at = out
    *heads, last = path.split(".")
    for h in heads:
        at = at[int(h)] if isinstance(at, list) else at[h]
    at[int(last) if isinstance(at, list) else last] = value
    return out


MODEL = protocol.MODEL
ML = protocol.ML | protocol.ML_RISK | {
    "downstream_risk_models": {"models": [{"model_id": m, "dependence": d} for m, d in (("M5", "gaussian"), ("M6", "vine_tree_3"), ("M7", "gaussian"), ("M8", "vine_tree_3"))]}
}
ML = edited(ML, "exploratory_inference.comparisons", [{"ml_model": m, "baseline_model": b, "dependence": d} for m, bs, d in (("M5", "M1 M3", "gaussian"), ("M6", "M2 M4", "vine_tree_3"), ("M7", "M1 M3", "gaussian"), ("M8", "M2 M4", "vine_tree_3")) for b in bs.split()])
COMPOSITION = protocol.COMPOSITION | {"interpretation": {"core_H1_H2_H3_revised": False}}
FULL = edited(protocol.FULL_VINE, "dm.comparisons", [{"model_id": "M2"}, {"model_id": "M4"}])
SPECS = [{"portfolio_id": f"p{k}", "input_grouping_id": f"i{k}", "model_grouping_id": f"g{k}", "historical_model_id": f"h{k}", "gaussian_model_id": f"n{k}", "vine_model_id": f"v{k}"} for k in (1, 2)]
BALANCED = protocol.BALANCED | {"portfolios": SPECS}
ACTION = {"action_id": "A", "research_ticker": "T", "effective_date": "2025-08-28", "cash_per_old_share": 11.45, "contingent_value_per_old_share": 0.53}
SENSITIVITY = protocol.SENSITIVITY | {
    "event": {"action_id": "A", "ticker": "T", "effective_date": "2025-08-28", "cash_per_old_share": 11.45, "primary_dap_value_per_old_share": 0.53},
    "evaluation": {"primary_reference_dap_value_per_old_share": 0.53},
    "scenarios": [{"scenario_id": "zero", "dap_value_per_old_share": 0.0}, {"scenario_id": "cap", "dap_value_per_old_share": 3.0}],
}
REPORTING = protocol.REPORTING | {"model_labels": {f"M{k}": str(k) for k in range(9)}, "method_labels": dict.fromkeys(protocol.REPORTING["clustering_method_order"], "x"), "palette": dict.fromkeys(protocol.REPORTING["clustering_method_order"], "#000000"), "sources": {"a": "b"}}
EVALUATION = {"model_ids": ["M0", "M1", "M2", "M3", "M4"], "primary_score_columns": protocol.SCORES, "calibration": {"family_size": 20}, "dm": {"family_size": 6, "hac_lag": 7}, "h1": {"replications": 10000}}


@pytest.mark.parametrize(
    "check,config,changes",
    [
        (protocol.historical, MODEL, {"forecast.minimum_training_observations": 600, "forecast.training_window_calendar_years": True, "clustering.evaluation_end_year": 2024, "portfolio.reconstruction_tolerance": 1e-6}),
        (lambda c: protocol.core_evaluation(c, MODEL), EVALUATION, {"model_ids": ["M0"], "dm.hac_lag": 8, "calibration.family_size": 10, "h1.replications": 100, "primary_score_columns": []}),
        (protocol.vine, MODEL, {"vine.maximum_failed_pair_fraction": 0.2, "vine.families": [], "simulation.dimension": 10}),
        (lambda c: protocol.vine(c, 10), MODEL, {"vine.dimension": 10, "vine.robustness_truncation_tree": 9}),
        (protocol.simulation, MODEL, {"simulation.base_seed": 1, "gaussian.eigenvalue_floor": 1e-6, "simulation.common_random_numbers": 1}),
        (protocol.marginal, MODEL, {"marginal.ewma_lambda": 0.9, "marginal.pit_clip_lower": 0.6, "marginal.fallback_order": ["ewma_empirical"]}),
        (protocol.ml_grouping, ML, {"kmeans.n_init": 10, "pca_kmeans.method_code": 1, "spectral.row_normalize_embedding": False}),
        (lambda c: protocol.ml_risk(c, MODEL), ML, {"exploratory_inference.family_size": 6, "downstream_risk_models.models.0.model_id": "M1", "exploratory_inference.comparisons.0.dependence": "vine_tree_3", "exploratory_inference.dm_hac_lag": 3}),
        (protocol.balanced, BALANCED, {"portfolio.transaction_costs": 0.1, "portfolios.1.portfolio_id": "p1", "portfolios.1.vine_model_id": "h1", "portfolios.0.model_grouping_id": ""}),
        (lambda c: protocol.balanced_risk(c, MODEL), BALANCED, {"models.vine_truncation_tree": 10, "evaluation.dm_family_size": 3, "evaluation.calibration_confidence_levels": [0.95]}),
        (lambda c: protocol.composition(c, MODEL), COMPOSITION, {"forecast.window_calendar_years": 2, "dm.family_size": 6, "interpretation.core_H1_H2_H3_revised": True, "models.robustness_model_id": "M9"}),
        (lambda c: protocol.full_vine(c, MODEL), FULL, {"evaluation.full_truncation_level": 9, "dm.comparisons": [{"model_id": "M2"}], "calibration.family_size": 8}),
        (lambda c: protocol.sensitivity(c, [ACTION]), SENSITIVITY, {"event.cash_per_old_share": 1.0, "event.effective_date": "2025-01-01", "scenarios.0.dap_value_per_old_share": 3.0, "scenarios.0.scenario_id": "cap", "scenarios.1.dap_value_per_old_share": 0.53, "event.action_id": "B", "execution.vine_truncation_tree": 10}),
        (protocol.reporting, REPORTING, {"float_significant_digits": 6, "model_labels": {}, "palette": {}, "sources": {}}),
    ],
)
def test_protocols_hold_and_name_what_differs(check, config, changes):
    check(config)
    for path, value in changes.items():
        with pytest.raises(protocol.ProtocolError) as error:
            check(edited(config, path, value))
        assert error.value.found


def test_vine_levels():
    assert protocol.vine(MODEL) == 3 and protocol.vine(MODEL, 10) == 10
    with pytest.raises(protocol.ProtocolError):
        protocol.vine(MODEL, 5)


def test_lineage(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data/a.txt").write_text("a")
    good = {"x": [{"path": "data/a.txt", "sha256": files.sha256(tmp_path / "data/a.txt")}]}
    lineage.require_current(good, tmp_path)
    assert not lineage.only_missing(good, tmp_path, ["data"])
    cases = {"missing:data/b.txt": {"path": "data/b.txt", "sha256": "0" * 64}, "stale:data/a.txt": {"path": "data/a.txt", "sha256": "0" * 64}, "outside:../b": {"path": "../b", "sha256": "0" * 64}, "malformed": {"path": "data/a.txt", "sha256": "xyz"}}
    for issue, record in cases.items():
        assert lineage.hash_issues({"y": record}, tmp_path) == [("$.y", issue)]
        assert lineage.only_missing(record, tmp_path, ["data"]) == issue.startswith("missing")
        with pytest.raises(RuntimeError):
            lineage.require_current(record, tmp_path)
    assert not lineage.only_missing(cases["missing:data/b.txt"], tmp_path, ["other"])
    with pytest.raises(ValueError):
        lineage.only_missing(good, tmp_path, ["../x"])
    files.write_json(tmp_path / "data/doc.json", good)
    assert lineage.verified_repository(tmp_path, ["data"])["status"] == "pass"
    files.write_json(tmp_path / "data/doc2.json", cases["malformed"])
    found = lineage.verified_repository(tmp_path, ["data"])
    assert found["status"] == "fail" and found["records"] == 2 and lineage.verified_repository(tmp_path, ["data"], {"data/doc2.json"})["status"] == "pass"


def gate(status="provisional_pass", modelling="pass_provisional", scope="provisional_research_results"):
    return {"foundation_v2": {"status": status, "reporting_scope": scope}, "gates": {"modelling_readiness": {"status": modelling}}}


def test_scopes_audits_and_run_manifest(tmp_path):
    assert lineage.reporting_scope(gate()) == "provisional_research_results" and lineage.reporting_scope(gate("pass", "pass", "confirmatory")) == "confirmatory"
    for bad in ({}, gate("blocked"), gate("pass"), gate(scope="anything"), gate(modelling="blocked")):
        with pytest.raises(RuntimeError):
            lineage.reporting_scope(bad)
    (tmp_path / "out.csv").write_text("x")
    digest = files.sha256(tmp_path / "out.csv")
    audit = {"status": "pass", "reporting_scope": "s", "analysis_role": "r", "outputs": {"table": {"path": "out.csv", "sha256": digest}, "assignments": {"path": "a.json", "sha256": ""}}}
    lineage.require_audit_output(audit, "table", tmp_path / "out.csv", "s", "r")
    for change in ({"status": "fail"}, {"reporting_scope": "t"}, {"analysis_role": "q"}, {"outputs": {}}, {"outputs": {"table": {"sha256": "0"}}}):
        with pytest.raises(RuntimeError):
            lineage.require_audit_output(audit | change, "table", tmp_path / "out.csv", "s", "r")
    files.write_json(tmp_path / "a.json", {"2020": {"A": "x"}})
    audit["outputs"]["assignments"]["sha256"] = files.sha256(tmp_path / "a.json")
    files.write_json(tmp_path / "audit.json", audit)
    assert lineage.audited_source(tmp_path, "audit.json", "s")["status"] == "pass" and lineage.bound_assignments(tmp_path, audit) == {"2020": {"A": "x"}}
    with pytest.raises(RuntimeError):
        lineage.audited_source(tmp_path, "audit.json", "t")
    with pytest.raises(RuntimeError):
        lineage.bound_assignments(tmp_path, {})
    arithmetic = {"status": "pass", "inputs": {k: {"sha256": digest} for k in ("stock_simple_returns", "active_universe")}}
    lineage.require_portfolio_binding(arithmetic, tmp_path / "out.csv", tmp_path / "out.csv")
    with pytest.raises(RuntimeError):
        lineage.require_portfolio_binding(arithmetic, tmp_path / "out.csv", tmp_path / "a.json")
    (tmp_path / "pyproject.toml").write_text('[project]\ndependencies = ["numpy>=1", "no-such-package==2; python_version>\'3\'"]\n')
    manifest = lambda **c: lineage.run_manifest(str(tmp_path), **({"configs": ["out.csv"], "inputs": ["a.json"], "outputs": ["audit.json"], "seed": 5110, "model_config": MODEL, "gate": gate(), "lineage": {"status": "pass"}} | c))
    made = manifest()
    assert made["environment"]["direct_dependency_versions"]["no-such-package"] is None and made["environment"]["direct_dependency_versions"]["numpy"]
    assert made["completeness"]["inputs"] and not made["completeness"]["complete"] and made["foundation_v2"]["run_scope"] == "provisional_research_results"
    assert not manifest(outputs=["none"])["completeness"]["outputs"] and manifest(gate=None)["foundation_v2"]["status"] == "unknown"
    with pytest.raises(ValueError):
        manifest(seed=1)


def test_report_is_written_whole_and_the_same_each_time(spark, tmp_path):
    summary = spark.createDataFrame([("M1", 0.1, 0.2, -3.0, 1.5, 2.0), ("M0", 0.2, 0.3, -2.0, 1.0, 1.0)], "model_id string, mean_quantile_loss_95 double, mean_quantile_loss_99 double, mean_fz0_975 double, average_primary_score_rank double, overall_rank double")
    performance = reports.performance_rows(summary, {"M0": "history", "M1": "copula"}, ["M0", "M1"])
    assert [(r["position"], r["model_id"], r["label"]) for r in performance] == [(1, "M0", "history"), (2, "M1", "copula")]
    with pytest.raises(ConstraintError):
        reports.performance_rows(summary, {}, ["M0"])
    tests = spark.createDataFrame([("M1", "M0", "fz0_975", True, False)], "model_id string, baseline_id string, score string, favours_model boolean, favours_baseline boolean")
    counts = reports.support_counts(tests)
    with pytest.raises(ConstraintError):
        reports.accuracy_rows(tests, 6)
    calibration = spark.createDataFrame([("M1", 0.95, 100, 7, 0.07), ("M0", 0.99, 100, 1, 0.01), ("M0", 0.95, 100, 5, 0.05)], "model_id string, level double, days long, exceptions long, exception_rate double")
    rates = reports.calibration_rows(calibration, ["M0", "M1"])
    assert [(r["model_id"], r["level"], round(r["expected_exceptions"], 6)) for r in rates] == [("M0", 0.95, 5.0), ("M0", 0.99, 1.0), ("M1", 0.95, 5.0)]
    gaps = spark.createDataFrame([(g, y, 0.5, 0.2, 0.3 + 0.01 * y % 1, 0.2) for g in ("gics", "spectral") for y in (2020, 2021)], "grouping_id string, year int, within_mean double, between_mean double, gap double, balanced_gap double")
    agreement = spark.createDataFrame([("spectral", 2020, 0.5, 0.6)], "grouping_id string, year int, ari double, nmi double")
    clusters = reports.clustering_rows(gaps, agreement, ["gics", "spectral"])
    assert len(clusters) == 4 and clusters[2]["ari"] == 0.5
    hypotheses = reports.hypothesis_rows({"status": "supported", "mean": 0.1, "lower": 0.01, "upper": 0.2, "replications": 10}, counts | {"status": "full_support"}, {"status": "supported", "unique_first_rank_models": ["M1"], "best_eligible_model": None})
    robustness = reports.robustness_rows({"full_vine": counts, "none": {"tests": 3, "for_model": 0, "for_baseline": 0}})
    assert [r["direction"] for r in robustness] == ["variant", "none"]
    days = [{"date": f"2020-01-{k:02d}", "realised_loss": 0.01 * k, "var_99": 0.05} for k in range(1, 10)]
    palette = {"gics": "#4C78A8", "spectral": "#54A24B"}
    figures = lambda: {
        "gaps.svg": reports.gap_figure(clusters, {"gics": "A & B", "spectral": "S"}, palette),
        "ranks.svg": reports.rank_figure(performance),
        "rates.svg": reports.exception_figure(rates),
        "losses.svg": reports.loss_figure(days, "M1"),
        "table.svg": reports.contingency_figure([{"l": "x", "r": "y", "n": 3}, {"l": "x", "r": "z", "n": 1}]),
    }
    quality = reports.quality_markdown({"gate_status": "pass", "candidate_securities": 2, "included_securities": 1, "duplicate_security_dates": 0, "nonpositive_closes": 0, "missing_log_returns": 1, "lifecycle_issues": 0, "missing_manual_action_ids": [], "unresolved_event_reviews": ["X"], "quality_flag_counts": {"f": 2}, "reference_event_disposition_counts": {"applied": 3}})
    assert "**pass**" in quality and "| f | 2 |" in quality and "X" in quality
    results = reports.results_markdown(performance, hypotheses, robustness, "confirmatory")
    assert "**H1** supported" in results and "| M0 | history |" in results
    made = [reports.write_report(tmp_path / k, {"p.csv": performance, "r.csv": robustness}, figures(), {"q.md": quality, "s.md": results}, "confirmatory", []) for k in "ab"]
    assert made[0] == made[1] and len(made[0]["artifacts"]) == 9
    assert lineage.hash_issues(json.loads((tmp_path / "a/report_manifest.json").read_text()), tmp_path / "a") == []
    svg = (tmp_path / "a/figures/gaps.svg").read_text()
    assert svg.count("<polyline") >= 2 and "A &amp; B" in svg and not re.search("nan|inf|date", svg)
    with pytest.raises(ConstraintError):
        reports.write_report(tmp_path / "c", {"p.csv": []}, {}, {}, "confirmatory", [])
    with pytest.raises(ValueError):
        reports.Canvas("x", float("nan"), 1.0)
