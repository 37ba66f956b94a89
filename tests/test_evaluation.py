"""Contracts of the evaluation families: each rule is broken once and must be found."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluation as ev
from riskloom.operators.quality import ConstraintError

MODELS = {"M0": "none", "M1": "gics"}
FAMILY = ev.Family("two", MODELS, frozenset({"M0"}))


def rows(n=40):
    out = []
    for k in range(n):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=9 * k)
        for m, g in MODELS.items():
            copula = m != "M0"
            out.append((day, m, g, f"{m}:{k}", 0.01, 0.02, 0.03, 0.025 + k * 1e-4, -0.001 * k, 0.001 * k, [5110, day.year, day.month] if copula else None, 0, False, "ok", 0.5 if copula else None))
    return out


SCHEMA = "date date, model_id string, grouping_id string, refit_id string, var_95 double, var_975 double, var_99 double, es_975 double, realised_simple_return double, realised_loss double, seed_components array<bigint>, margin_fallback_count int, whole_vine_fallback boolean, forecast_status string, copula_log_score double"


@pytest.fixture(scope="module")
def forecasts(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def spoilt(frame, column, value):
    first = (F.col("model_id") == "M1") & (F.col("date") == F.lit(dt.date(2020, 1, 1)))
    return frame.withColumn(column, F.when(first, value).otherwise(F.col(column)))


@pytest.mark.parametrize(
    "column,value,code",
    [
        ("var_95", float("nan"), "nonfinite_value"),
        ("var_95", 0.5, "nonmonotone_var"),
        ("es_975", 0.001, "es_below_var"),
        ("realised_loss", 0.3, "loss_identity"),
        ("copula_log_score", None, "copula_score"),
        ("forecast_status", "failed", "unsupported_status"),
        ("grouping_id", "none", "wrong_grouping"),
    ],
)
def test_each_rule_of_the_forecast_contract(forecasts, column, value, code):
    value = F.lit(value).cast(forecasts.schema[column].dataType)
    assert ev.forecast_problems(forecasts, FAMILY).count() == 0
    found = ev.forecast_problems(spoilt(forecasts, column, value), FAMILY).collect()
    assert code in {r.code for r in found} and {r.model_id for r in found} == {"M1"}
    with pytest.raises(ConstraintError):
        ev.checked(spoilt(forecasts, column, value), FAMILY)


def test_record_must_be_exact(forecasts):
    assert ev.normalised(forecasts, set(MODELS)).columns == list(ev.FORECAST_COLUMNS)
    with pytest.raises(ConstraintError):
        ev.normalised(forecasts.drop("refit_id"), set(MODELS))
    with pytest.raises(ConstraintError):
        ev.normalised(forecasts, {"M0", "M2"})
    with pytest.raises(ConstraintError):
        ev.normalised(forecasts.unionByName(forecasts.limit(1)), set(MODELS))
    assert set(ev.scored(forecasts).columns) >= set(ev.SCORE_COLUMNS)


def test_dates_and_losses_must_match(forecasts):
    ev.matched(forecasts)
    with pytest.raises(ConstraintError):
        ev.matched(forecasts.where("model_id = 'M0' or date > date'2020-01-01'"))
    with pytest.raises(ConstraintError):
        ev.matched(spoilt(forecasts, "realised_loss", F.lit(0.25)))
    both = forecasts.withColumn("portfolio_id", F.lit("a")).unionByName(spoilt(forecasts, "realised_loss", F.lit(0.0)).withColumn("portfolio_id", F.lit("b")))
    ev.matched(both, ("portfolio_id", "model_id"), ("portfolio_id",))  # losses of other portfolios may differ


def test_seeds_years_and_foreign_diagnostics(forecasts):
    copula = forecasts.where("model_id = 'M1'")
    assert ev.seed_problems(copula).count() == 0
    assert ev.seed_problems(spoilt(copula, "seed_components", F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<bigint>"))).count() == 1
    assert ev.historical_problems(forecasts.where("model_id = 'M0'")).count() == 0 and ev.historical_problems(copula).count() == copula.count()
    assert {(r.model_id, r.year, r.code) for r in ev.missing_years(forecasts, 2020, 2021).collect()} == {("M0", 2021, "missing_year"), ("M1", 2021, "missing_year")}
    assert ev.missing_years(forecasts, 2020, 2020).count() == 0


def test_family_sizes_are_exact(forecasts):
    scores = ev.scored(forecasts)
    assert ev.calibration_family(scores, tests=8).count() == 4
    with pytest.raises(ConstraintError):
        ev.calibration_family(scores, tests=20)
    better = scores.withColumns({x: F.col(x) + F.when(F.col("model_id") == "M1", F.sin(F.dayofyear("date").cast("double")) / 100 - 0.05).otherwise(0.0) for x in ev.PRIMARY_SCORES})
    found = ev.accuracy_family(better, [("M1", "M0")], ev.Family("two", MODELS, accuracy_tests=3)).collect()
    assert len(found) == 3 and all(r.favours_model and not r.favours_baseline and r.direction == "model_lower_loss" for r in found)
    with pytest.raises(ConstraintError):
        ev.accuracy_family(better, [("M1", "M0")], ev.Family("two", MODELS, accuracy_tests=6))
    assert ev.copula_support(ev.accuracy_family(better, [("M1", "M0")], FAMILY)).first().status == "full_support"
    assert ev.copula_support(ev.accuracy_family(better, [("M0", "M1")], FAMILY)).first().status == "no_support"


def test_whole_family(forecasts):
    found = ev.evaluate(forecasts.withColumn("es_975", F.when(F.col("model_id") == "M1", F.col("es_975") + F.abs(F.sin(F.dayofyear("date").cast("double"))) / 50).otherwise(F.col("es_975"))).withColumn("var_95", F.when(F.col("model_id") == "M1", F.col("var_95") * (1 - F.dayofyear("date") / 5000)).otherwise(F.col("var_95"))).withColumn("var_99", F.when(F.col("model_id") == "M1", F.col("var_99") * (1 + F.dayofyear("date") / 5000)).otherwise(F.col("var_99"))), FAMILY, [("M1", "M0")], (2020, 2020))
    assert set(found) == {"scores", "calibration", "annual_calibration", "accuracy", "summaries"}
    assert found["summaries"].count() == 2 and found["scores"].count() == forecasts.count()


def refits(spark, level, pairs, start="2017-01-01"):
    return spark.createDataFrame(
        [(2020, m, "fixed", model, g, level, pairs, 5, 3 + m, 1.0 * m, 2.0, False, start) for m in (1, 2) for model, g in (("M2", "gics"), ("M4", "hierarchical"))],
        "year int, month int, universe_variant string, model_id string, grouping_id string, truncation_level int, pair_count int, dimension int, number_parameters int, aic double, bic double, whole_vine_fallback boolean, training_start string",
    )


def test_refits_share_their_information_sets(spark):
    models, columns = {"M2": "gics", "M4": "hierarchical"}, ["dimension", "training_start"]
    primary, full = refits(spark, 3, 4 + 3 + 2), refits(spark, 4, 4 + 3 + 2 + 1)
    row = ev.refit_identity(primary, full, columns, models, (3, 4)).first()
    assert (row.matched_refit_count, row.primary_pair_count_total, row.full_pair_count_total) == (4, 36, 40)
    for bad in (refits(spark, 4, 10, "2018-01-01"), refits(spark, 4, 9), full.where("month = 1"), refits(spark, 5, 10), full.unionByName(full)):
        with pytest.raises(ConstraintError):
            ev.refit_identity(primary, bad, columns, models, (3, 4))
    row = ev.fit_complexity(primary, "primary").first()
    assert (row.accepted_refits, row.mean_number_parameters, row.mean_aic) == (4, 4.5, 1.5)


def test_window_issues(spark, forecasts):
    own = forecasts.where("model_id = 'M0'")
    windows = own.select("refit_id", F.col("date").alias("forecast_date"), F.date_sub("date", 1).alias("training_end"), F.lit(750).alias("training_observations"))
    assert ev.window_issues(own, windows, 40) == []
    bad = windows.withColumns({"training_end": F.col("forecast_date"), "training_observations": F.lit(699)}).limit(39)
    assert ev.window_issues(own, bad, 41) == ["incomplete_coverage", "invalid_window_binding", "insufficient_training", "training_lookahead"]


def test_gap_support():
    assert ev.gap_support({"mean": 0.1, "lower": 0.01}) == "supported" and ev.gap_support({"mean": 0.1, "lower": 0.0}) == "not_supported"
