"""The chain from group returns to forecasts: each rule is broken once, and one month of every copula is forecast."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import chain, copula, margins, vine
from riskloom.operators.quality import ConstraintError

GROUPS = list("abc")


@pytest.fixture(scope="module")
def returns(spark):
    days = pd.bdate_range("2017-01-02", "2020-01-31")
    rng = np.random.default_rng(5)
    common = rng.standard_normal(len(days))
    rows = pd.concat([pd.DataFrame({"group_id": g, "date": days.date, "log_return": 0.01 * (0.7 * common + 0.7 * rng.standard_normal(len(days))), "portfolio_weight": w, "group_size": n}) for g, w, n in zip(GROUPS, (0.5, 0.25, 0.25), (4, 2, 2))])
    return spark.createDataFrame(rows)


@pytest.fixture(scope="module")
def fitted(spark):
    """A month's margins without the fits: unit variance, known residuals."""
    train, days = pd.bdate_range("2017-01-02", "2019-12-31"), pd.bdate_range("2020-01-01", "2020-01-10")
    rng = np.random.default_rng(6)
    z = rng.standard_normal((len(train), 1)) * 0.8 + rng.standard_normal((len(train), 3)) * 0.6
    refit = days[0].date()
    refits = pd.DataFrame({"refit_date": refit, "group_id": GROUPS, "refit_id": [f"{g}:1" for g in GROUPS], "df": [None, 8.0, 5.0]})
    training = pd.concat([pd.DataFrame({"refit_date": refit, "refit_id": f"{g}:1", "date": train.date, "group_id": g, "log_return": 0.01 * z[:, i], "residual": z[:, i], "pit": np.clip(margins.midrank(z[:, i], z[:, i]), 1e-6, 1 - 1e-6)}) for i, g in enumerate(GROUPS)])
    daily = pd.concat([pd.DataFrame({"refit_date": refit, "refit_id": f"{g}:1", "date": days.date, "group_id": g, "mean": 0.0, "volatility": 0.01, "pit": 0.4, "log_return": -0.01, "residual": -1.0, "portfolio_weight": w}) for g, w in zip(GROUPS, (0.5, 0.25, 0.25))])
    make = spark.createDataFrame
    return {"refits": make(refits.astype(object).where(refits.notna(), None), "refit_date date, group_id string, refit_id string, df double"), "training": make(training), "daily": make(daily)}


def codes(rows):
    return {r.code for r in rows.collect()}


def test_group_panel_rules(returns):
    assert codes(chain.group_panel_problems(returns)) == set() and codes(chain.size_weight_problems(returns)) == set()
    first = (F.col("group_id") == "a") & (F.col("date") == "2017-01-02")
    change = lambda c, x: returns.withColumn(c, F.when(first, F.lit(x)).otherwise(F.col(c)))
    assert codes(chain.group_panel_problems(change("log_return", float("nan")))) == {"nonfinite_return"}
    assert codes(chain.group_panel_problems(change("portfolio_weight", -0.5))) == {"invalid_weight", "weights_do_not_sum_to_one"}
    assert "repeated_group_date" in codes(chain.group_panel_problems(returns.unionByName(returns.limit(1))))
    assert codes(chain.size_weight_problems(change("group_size", 9))) == {"weight_identity"}
    with pytest.raises(ConstraintError):
        chain.refit_tasks(returns.unionByName(returns))
    rows = {(r.group_id, str(r.refit_date)): r for r in chain.refit_tasks(returns).collect()}
    row = rows["a", "2020-01-01"]
    assert str(row.training_end) == "2019-12-31" and str(row.training_start) == "2017-01-02" and row.evaluation_days == 23 and row.observations == 782


def test_bindings_and_look_ahead(fitted):
    problems = lambda **x: codes(chain.binding_problems(*[x.get(k, fitted[k]) for k in ("training", "refits", "daily")]))
    assert problems() == set()
    wrong = F.when(F.col("group_id") == "b", F.lit("x")).otherwise(F.col("refit_id"))
    assert problems(training=fitted["training"].withColumn("refit_id", wrong)) == {"training_binding"}
    assert problems(daily=fitted["daily"].withColumn("refit_id", wrong)) == {"daily_binding"}
    assert problems(training=fitted["training"].withColumn("date", F.date_add("date", 31))) == {"training_lookahead"}
    assert "daily_precedes_refit" in problems(daily=fitted["daily"].withColumn("date", F.date_sub("date", 40)))
    assert problems(refits=fitted["refits"].unionByName(fitted["refits"])) >= {"repeated_refit"}
    assert problems(training=fitted["training"].where("group_id <> 'c'")) == {"refit_without_training"}
    assert problems(training=fitted["training"].unionByName(fitted["training"])) >= {"repeated_training_row"}


def test_alignment(fitted):
    hole = fitted["training"].where("not (group_id = 'a' and date = '2019-12-31')")
    assert chain.aligned(hole, 3).where("date = '2019-12-31'").count() == 0 and chain.aligned(hole).count() == fitted["training"].count() - 3
    with pytest.raises(ConstraintError):
        chain.aligned(hole, 11)
    assert codes(chain.block_problems(fitted["training"], 3)) == set()
    assert codes(chain.block_problems(hole, 3)) == {"incomplete_date"} and "dimension" in codes(chain.block_problems(hole, 4))
    assert codes(chain.block_problems(fitted["training"].withColumn("pit", F.lit(1.0)), 3)) == {"outside_unit_interval"}


def test_smoothed_margins_come_out_again(spark, returns):
    r = np.array([x.log_return for x in returns.where("group_id = 'a' and date < '2019-12-31'").orderBy("date").collect()])
    margin = margins.ewma(r * margins.SCALE)
    z = chain.ewma_innovations(r, margin.constant, margin.next_variance)
    assert np.allclose(z, margins.residuals(margin, r))
    for bad in ({"constant": margin.constant + 1e-6}, {"next_variance": margin.next_variance * 1.001}):
        with pytest.raises(ValueError):
            chain.ewma_innovations(r, **({"constant": margin.constant, "next_variance": margin.next_variance} | bad))
    refit = ("a:1", "a", "ewma", pd.Timestamp("2017-01-02").date(), pd.Timestamp("2019-12-30").date(), len(r), margin.constant, margin.next_variance)
    schema = "refit_id string, group_id string, method string, training_start date, training_end date, observations int, constant double, next_variance double"
    assert codes(chain.ewma_problems(spark.createDataFrame([refit], schema), returns)) == set()
    assert codes(chain.ewma_problems(spark.createDataFrame([(*refit[:5], 3, *refit[6:])], schema), returns)) == {"ewma_sample"}
    assert codes(chain.ewma_problems(spark.createDataFrame([(*refit[:7], 9.0)], schema), returns)) == {"ewma_not_reproduced"}


def test_rejections_name_every_broken_limit():
    good = {"phi": 0.1, "omega": 0.1, "alpha": 0.1, "beta": 0.8, "df": 5.0, "variance": 1.0}
    assert margins.rejection_reasons(**good) == []
    bad = {"phi": 0.99, "omega": 0.0, "alpha": -0.1, "beta": 1.2, "df": 2.0, "variance": 0.0}
    assert margins.rejection_reasons(**bad) == ["ar_absolute_limit", "nonpositive_omega", "negative_alpha", "garch_persistence_limit", "student_t_df_minimum", "nonpositive_forecast_variance"]
    assert margins.rejection_reasons(**(bad | {"omega": float("nan")})) == [margins.NONFINITE]


def forecasts(fitted, out="forecasts", **x):
    parts = [x.get(k, fitted[k]) for k in ("daily", "refits", "training")]
    return copula.block_forecasts(*parts, x.get("model", "M1"), "gics", x.get("truncation"), 4000, out=out)


def test_forecasts_of_both_copulas_share_their_numbers(fitted):
    gauss, vines = forecasts(fitted).toPandas(), forecasts(fitted, model="M2", truncation=2).toPandas()
    for found in (gauss, vines):
        assert len(found) == 8 and (found.var_95 <= found.var_975).all() and (found.es_975 >= found.var_975).all()
        assert np.allclose(found.realised_loss, -np.expm1(-0.01)) and set(map(tuple, found.seed_components)) == {(5110, 2020, 1)} and set(found.forecast_status) == {"fallback"}
    assert np.isclose(gauss.var_99, vines.var_99, rtol=0.1).all() and not np.isclose(gauss.var_99, vines.var_99, rtol=1e-9).all()
    a, b = forecasts(fitted, "records").first(), forecasts(fitted, "records", model="M2", truncation=2).first()
    assert a.uniform_sha256 == b.uniform_sha256 == copula.uniform_sha256(copula.common_uniforms(2020, 1, 4000, 3)) and json.loads(a.group_order) == GROUPS
    assert (a.pair_count, b.pair_count, b.truncation_level, b.whole_vine_fallback, a.number_parameters) == (None, 3, 2, False, 3)
    assert a.aic == pytest.approx(2 * 3 - 2 * a.log_likelihood) and a.training_days == 782 and a.condition_number > 1


@pytest.mark.parametrize(
    "part,change",
    [
        ("training", lambda df: df.withColumn("date", F.add_months("date", 1))),
        ("daily", lambda df: df.withColumn("date", F.date_sub("date", 40))),
        ("daily", lambda df: df.withColumn("portfolio_weight", F.col("portfolio_weight") * 2)),
        ("daily", lambda df: df.withColumn("volatility", F.lit(0.0))),
        ("daily", lambda df: df.where("not (group_id = 'a' and date = '2020-01-02')")),
        ("training", lambda df: df.where("group_id <> 'a'")),
    ],
)
def test_forecasts_fail_on_invalid_blocks(fitted, part, change):
    with pytest.raises(Exception, match="ValueError|PythonException|UDF"):
        forecasts(fitted, **{part: change(fitted[part])}).collect()


def test_a_vine_that_cannot_be_fitted_falls_back(fitted, monkeypatch):
    assert vine.vine_or_gaussian(np.full((50, 3), np.nan), 2)[0] is None
    good = np.clip(np.random.default_rng(1).random((400, 3)), 1e-6, 1 - 1e-6)
    trees, reason = vine.vine_or_gaussian(good, 2)
    assert reason is None and vine.parameters(trees) <= 6


def test_quality_gates(spark, fitted):
    records = forecasts(fitted, "records").unionByName(forecasts(fitted, "records", model="M2", truncation=2))
    both = forecasts(fitted).unionByName(forecasts(fitted, model="M2", truncation=2)).persist()
    good = chain.forecast_quality(records, both, {"M1", "M2"}, "copula")
    assert good["status"] == "pass" and good["model_dates"] == {"M1": 8, "M2": 8}
    assert "incomplete_matched_model_coverage" in chain.forecast_quality(records, both, {"M1", "M2", "M3"}, "copula")["issues"]
    assert "duplicate_copula_forecast" in chain.forecast_quality(records, both.unionByName(both), {"M1", "M2"}, "copula")["issues"]
    off = both.withColumn("realised_simple_return", F.when(F.col("model_id") == "M2", 0.5).otherwise(F.col("realised_simple_return")))
    assert chain.forecast_quality(records, off, {"M1", "M2"}, "copula")["issues"] == ["grouping_portfolio_identity_failed"]
    assert "es_below_var" in chain.forecast_quality(records, both.withColumn("es_975", F.lit(-1.0)), {"M1", "M2"}, "copula")["issues"]
    rows = {r.model_id: r for r in chain.vine_eligibility(both.withColumn("whole_vine_fallback", (F.col("model_id") == "M2") & (F.dayofmonth("date") == 2))).collect()}
    assert rows["M1"].eligible and not rows["M2"].eligible and rows["M2"].fallback_share == 0.125
    assert chain.all_eligible(chain.vine_eligibility(both)) and not chain.all_eligible(chain.vine_eligibility(both.limit(0)))
    refits = fitted["refits"].withColumns({"method": F.when(F.col("df").isNull(), "ewma").otherwise("garch_t"), "evaluation_days": F.lit(8)})
    found = chain.margin_quality(refits, fitted["daily"], fitted["training"])
    assert found["issues"] == ["ewma_fit_fraction_exceeds_limit"] and found["aligned_days"] == [782, 782]
    found = chain.margin_quality(refits.withColumn("method", F.lit("garch_t")), fitted["daily"].withColumn("pit", F.lit(0.0)), fitted["training"], 800)
    assert found["issues"] == ["insufficient_aligned_training_pit_dates", "pit_outside_frozen_bounds"]
    assert codes(chain.refit_calendar_problems(fitted["refits"])) == {"incomplete_annual_refit_schedule"}
    matched = chain.matched_gaussian(records.where("model_id = 'M2'"), records.where("model_id = 'M1'"), {"M2": "M1"})
    assert matched.first().gaussian_refit_id == "M1:2020-01"
    for bad in (records.where("model_id = 'M1'").withColumn("uniform_sha256", F.lit("0")), records.where("model_id = 'M1'").withColumn("group_order", F.lit("[]")), records.limit(0), records.where("model_id = 'M1'").unionByName(records.where("model_id = 'M1'"))):
        with pytest.raises(ConstraintError):
            chain.matched_gaussian(records.where("model_id = 'M2'"), bad, {"M2": "M1"})
    manifest = chain.seed_manifest([(2020, 1)], 4000, 3)
    assert codes(chain.crn_problems(records, manifest)) == set()
    assert codes(chain.crn_problems(records, chain.seed_manifest([(2020, 1)], 4000, 2))) == {"common_random_numbers"}
    assert chain.records_as_json(records)[0]["group_order"] == GROUPS


def test_seed_manifest_rules():
    manifest = chain.seed_manifest([(2020, 2), (2020, 1)], 10, 2)
    simulation = {"bit_generator": "PCG64DXSM", "base_seed": 5110, "draws_per_month": 10, "dimension": 2}
    assert list(chain.validated_seeds(manifest, simulation)) == [(2020, 1), (2020, 2)]
    first = manifest["records"][0]
    for change in ({"month": 13}, {"year": True}, {"draws": 9}, {"dimension": 3}, {"seed_components": [1, 2020, 1]}, {"base_uniform_sha256": "xyz"}):
        assert chain.seed_record_problem(first | change, manifest)
        with pytest.raises(ValueError):
            chain.validated_seeds(manifest | {"records": [first | change]}, simulation)
    for bad in (manifest | {"schema_version": 2}, manifest | {"records": [first, first]}, manifest | {"records": None}, manifest | {"base_seed": 1}):
        with pytest.raises(ValueError):
            chain.validated_seeds(bad, simulation)
    chain.require_same_seeds(manifest, json.loads(json.dumps(manifest)))
    with pytest.raises(ValueError):
        chain.require_same_seeds(manifest, manifest | {"records": []})


def test_roles_and_registries(tmp_path):
    assert chain.role_folder(tmp_path, "primary", 3) != chain.role_folder(tmp_path, "robustness", 10)
    for role, trees in (("primary", 10), ("robustness", 3), ("other", 3)):
        with pytest.raises(ConstraintError):
            chain.role_folder(tmp_path, role, trees)
    chain.validated_registry({"gics": ("M1", "gics"), "hierarchical": ("M3", "hierarchical")})
    for bad in ({}, {"gics": ("M1", "")}, {"gics": ("M1", "gics"), "h": ("M1", "h")}, {"gics": ("M1", "g"), "h": ("M3", "g")}, {"gics": ("M1", "g"), "h": ("M3",)}):
        with pytest.raises(ConstraintError):
            chain.validated_registry(bad)
    with pytest.raises(ValueError):
        copula.validated_correlation(np.array([[1.0, 1.0], [1.0, 1.0]]))
