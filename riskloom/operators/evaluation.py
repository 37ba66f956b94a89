"""Evaluation families: which forecasts belong together, the contracts they keep, and their tests, summaries and decisions.

A family names its models, what tells its rows apart, and how many tests are adjusted together. Forecasts are matched by
unions and aggregates, never by joining a frame with itself; only p-values leave the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import inference, risk
from .quality import ConstraintError, finite, require_columns, require_none, require_unique

# Columns of the forecast record, and of the score record beyond it.
FORECAST_COLUMNS = (
    "date", "model_id", "grouping_id", "refit_id", "var_95", "var_975", "var_99", "es_975", "realised_simple_return", "realised_loss", "seed_components",
    "margin_fallback_count", "whole_vine_fallback", "forecast_status", "copula_log_score",
)
SCORE_COLUMNS = (
    "date", "model_id", "grouping_id", "forecast_status", "var_95", "var_975", "var_99", "es_975", "realised_simple_return", "realised_loss", "quantile_loss_95",
    "quantile_loss_99", "fz0_975", "exception_95", "exception_975", "exception_99", "copula_log_score", "margin_fallback_count", "whole_vine_fallback",
)
RISK_COLUMNS = ("var_95", "var_975", "var_99", "es_975", "realised_simple_return", "realised_loss")
PRIMARY_SCORES = ("quantile_loss_95", "quantile_loss_99", "fz0_975")
LEVELS = ("95", "99")


@dataclass(frozen=True)
class Family:
    """models: model_id -> grouping_id; historical: models without a copula; keys: what tells a forecaster apart."""

    name: str
    models: dict[str, str]
    historical: frozenset[str] = frozenset()
    keys: tuple[str, ...] = ("model_id",)
    statuses: tuple[str, ...] = ("ok", "fallback")
    calibration_tests: int | None = None
    accuracy_tests: int | None = None
    adjustment: str = "holm"
    tolerance: float = 1e-12


# The families' models, groupings and numbers of tests.
CORE = Family("core", {"M0": "none", "M1": "gics", "M2": "gics", "M3": "hierarchical", "M4": "hierarchical"}, frozenset({"M0"}), calibration_tests=20, accuracy_tests=6)
ML = Family("ml", {"M5": "spectral", "M6": "spectral", "M7": "pca_kmeans", "M8": "pca_kmeans"}, accuracy_tests=24, adjustment="bh")
COMPOSITION = Family("current_composition", {"M0": "none", "M0_CC": "none"}, frozenset({"M0", "M0_CC"}), calibration_tests=8, accuracy_tests=3)
FULL_VINE = Family("full_vine", {"M2": "gics", "M4": "hierarchical"}, keys=("model_id", "truncation_level"), calibration_tests=16, accuracy_tests=6)
BALANCED = Family("group_balanced", {}, keys=("portfolio_id", "model_id"), calibration_tests=24, accuracy_tests=6)
CORE_PAIRS = (("M2", "M1"), ("M4", "M3"))


def normalised(frame: DataFrame, models: set[str], columns: tuple[str, ...] = FORECAST_COLUMNS, keys: tuple[str, ...] = ("model_id", "date"), name: str = "forecasts") -> DataFrame:
    """The frozen columns in their order, dates as dates; exactly ``models``, and one row for each of ``keys``."""
    require_columns(frame, list(columns), name)
    rows = frame.select(*columns).withColumn("date", F.to_date("date"))
    require_none(rows.where("date is null"), f"{name}: no date")
    require_unique(rows, list(keys), name)
    found = {r.model_id for r in rows.select("model_id").distinct().collect()}
    if found != models:
        raise ConstraintError(f"{name}: models {sorted(map(str, found))}, not {sorted(models)}")
    return rows


def _sign_error() -> Column:
    return F.abs(F.col("realised_loss") + F.col("realised_simple_return"))


def forecast_problems(rows: DataFrame, family: Family) -> DataFrame:
    """(code, model_id, date) of every row that breaks the contract of forecasts, one row for each rule broken."""
    not_finite = F.lit(False)
    for c in RISK_COLUMNS:
        not_finite = not_finite | ~finite(F.col(c))
    grouping = F.create_map(*[F.lit(x) for pair in family.models.items() for x in pair]) if family.models else None
    historical = F.col("model_id").isin(*family.historical) if family.historical else F.lit(False)
    score = F.col("copula_log_score")
    rules = {
        "nonfinite_value": not_finite,
        "nonmonotone_var": (F.col("var_95") > F.col("var_975")) | (F.col("var_975") > F.col("var_99")),
        "es_below_var": (F.col("es_975") < F.col("var_975")) | (F.col("es_975") <= 0),
        "loss_identity": _sign_error() > family.tolerance,
        "copula_score": (historical & score.isNotNull()) | (~historical & ~finite(score)),
    }
    if "forecast_status" in rows.columns:
        rules["unsupported_status"] = F.coalesce(~F.col("forecast_status").isin(*family.statuses), F.lit(True))
    if "grouping_id" in rows.columns and grouping is not None:
        rules["wrong_grouping"] = ~F.col("grouping_id").eqNullSafe(F.try_element_at(grouping, F.col("model_id")))
    codes = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in rules.items()])))
    return rows.select(codes.alias("code"), "model_id", "date")


def seed_problems(rows: DataFrame, base_seed: int = 5110) -> DataFrame:
    """Copula forecasts whose seed is not (base seed, year, month) of their date."""
    own = F.array(F.lit(base_seed), F.year("date"), F.month("date")).cast("array<bigint>")
    return rows.where(~F.col("seed_components").cast("array<bigint>").eqNullSafe(own)).select(F.lit("wrong_seed").alias("code"), "model_id", "date")


def historical_problems(rows: DataFrame) -> DataFrame:
    """Diagnostics that only copula models have, in forecasts of historical simulation."""
    foreign = (
        F.col("seed_components").isNotNull()
        | F.col("copula_log_score").isNotNull()
        | (F.coalesce("margin_fallback_count", F.lit(-1)) != 0)
        | F.coalesce("whole_vine_fallback", F.lit(True))
        | (F.coalesce("forecast_status", F.lit("")) != "ok")
        | (F.coalesce("grouping_id", F.lit("")) != "none")
    )
    return rows.where(foreign).select(F.lit("foreign_diagnostic").alias("code"), "model_id", "date")


def missing_years(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Years of the evaluation without a forecast, and forecasts of other years, by model."""
    have = rows.select("model_id", F.year("date").alias("year")).distinct()
    expected = rows.select("model_id").distinct().select("model_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return expected.join(have, ["model_id", "year"], "left_anti").select("model_id", "year", F.lit("missing_year").alias("code")).unionByName(
        have.join(expected, ["model_id", "year"], "left_anti").select("model_id", "year", F.lit("foreign_year").alias("code"))
    )


def matched(rows: DataFrame, keys: tuple[str, ...] = ("model_id",), within: tuple[str, ...] = (), tolerance: float = 1e-12) -> DataFrame:
    """``rows``, if within each of ``within`` every forecaster has the same dates and all share one realised loss a date."""
    forecasters = rows.select(*within, *[k for k in keys if k not in within]).distinct()
    count = forecasters.groupBy(*within).agg(F.count("*").alias("forecasters"))
    by_date = rows.groupBy(*within, "date").agg(F.count("*").alias("n"), (F.max("realised_loss") - F.min("realised_loss")).alias("spread"))
    joined = by_date.join(count, list(within)) if within else by_date.join(count)
    require_none(joined.where((F.col("n") != F.col("forecasters")) | (F.col("spread") > tolerance)), "forecasts do not match")
    return rows


def checked(rows: DataFrame, family: Family, years: tuple[int, int] | None = None) -> DataFrame:
    """``rows``, if they keep the family's contract and match."""
    require_none(forecast_problems(rows, family), f"{family.name} forecasts")
    if years:
        require_none(missing_years(rows, *years), f"{family.name} years")
    within = ("portfolio_id",) if "portfolio_id" in family.keys else ()
    return matched(rows, family.keys, within, family.tolerance)


def scored(rows: DataFrame) -> DataFrame:
    """The daily score record of forecasts."""
    return risk.daily_scores(rows)


def exception_series(scores: DataFrame, keys: tuple[str, ...], levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(keys, level, date, hit)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(float(f"0.{x}")).alias("level"), F.col(f"exception_{x}").cast("int").alias("hit")) for x in levels]))
    return scores.select(*keys, "date", pairs.alias("p")).select(*keys, "p.level", "date", "p.hit")


def calibration_family(scores: DataFrame, keys: tuple[str, ...] = ("model_id",), levels: tuple[str, ...] = LEVELS, tests: int | None = None, alpha: float = 0.05) -> DataFrame:
    """Full-period tests of coverage and independence, all adjusted as one family of ``tests`` p-values."""
    by = [*keys, "level"]
    rows = inference.calibration(exception_series(scores, keys, levels), *by)
    rows = rows.withColumn("exception_rate", F.col("exceptions") / F.col("days"))
    each = F.explode(F.array(F.struct(F.lit("uc").alias("test"), F.col("p_uc").alias("p")), F.struct(F.lit("ind").alias("test"), F.col("p_ind").alias("p"))))
    long = rows.select(*by, each.alias("t")).select(*by, "t.test", "t.p")
    if tests is not None and (found := long.count()) != tests:
        raise ConstraintError(f"a calibration family of {found} tests, not {tests}")
    adjusted = inference.holm(long, "p", [*by, "test"]).groupBy(*by).agg(
        *[F.max(F.when(F.col("test") == x, F.col("p_holm"))).alias(f"p_{x}_holm") for x in ("uc", "ind")]
    )
    out = rows.join(adjusted, by)
    return out.withColumns({f"reject_{x}": F.col(f"p_{x}_holm") < alpha for x in ("uc", "ind")})


def annual_calibration(scores: DataFrame, keys: tuple[str, ...] = ("model_id",), levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """The same tests by calendar year, descriptive and unadjusted."""
    rows = scores.withColumn("year", F.year("date"))
    by = [*keys, "year", "level"]
    found = inference.calibration(exception_series(rows, (*keys, "year"), levels), *by)
    return found.withColumns({"exception_rate": F.col("exceptions") / F.col("days"), "inference_role": F.lit("descriptive")})


def accuracy_family(scores: DataFrame, pairs: list[tuple[str, str]], family: Family, losses: tuple[str, ...] = PRIMARY_SCORES, lags: int = 7, level: float = 0.05, forecaster: str = "model_id") -> DataFrame:
    """Equal-accuracy tests of every pair and loss, adjusted as one family; directions say which side has the lower loss."""
    spark = scores.sparkSession
    table = spark.createDataFrame(pairs, "model_id string, baseline_id string")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("score"), F.col(x).alias("loss")) for x in losses]))
    long = scores.select(F.col(forecaster).alias("model_id"), "date", each.alias("s")).select("model_id", "date", "s.score", "s.loss")
    differences = inference.loss_differences(long, table, "loss", "score")
    found = inference.with_p_values(inference.diebold_mariano(differences, lags, "model_id", "baseline_id", "score"))
    require_none(found.where("p_value is null"), "a long-run variance is not positive")
    if family.accuracy_tests is not None and (n := found.count()) != family.accuracy_tests:
        raise ConstraintError(f"an accuracy family of {n} tests, not {family.accuracy_tests}")
    order = ["model_id", "baseline_id", "score"]
    adjust = inference.holm if family.adjustment == "holm" else inference.benjamini_hochberg
    column = "p_holm" if family.adjustment == "holm" else "p_bh"
    out = adjust(found, "p_value", order)
    lower = F.when(F.col("mean_difference") < 0, "model_lower_loss").when(F.col("mean_difference") > 0, "baseline_lower_loss").otherwise("equal_loss")
    sure = F.col(column) < level
    return out.withColumns(
        {"direction": lower, "favours_model": sure & (F.col("mean_difference") < 0), "favours_baseline": sure & (F.col("mean_difference") > 0), "hac_lag": F.lit(lags)}
    )


def summaries(scores: DataFrame, calibration: DataFrame | None, keys: tuple[str, ...] = ("model_id",), within: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """Mean losses, exceptions and rates of each forecaster, adjusted rejections, and ranks averaged over the three losses."""
    exceptions = [x for level in ("95", "975", "99") for x in (F.sum(F.col(f"exception_{level}").cast("long")).alias(f"exceptions_{level}"), F.avg(F.col(f"exception_{level}").cast("double")).alias(f"exception_rate_{level}"))]
    rows = scores.groupBy(*keys).agg(
        F.count("*").alias("observations"),
        *[F.avg(x).alias(f"mean_{x}") for x in PRIMARY_SCORES],
        F.avg("copula_log_score").alias("mean_copula_log_score"),
        *exceptions,
        *[F.first(x, ignorenulls=True).alias(x) for x in extra],
    )
    if calibration is not None:
        rejected = F.col("reject_uc").cast("long") + F.col("reject_ind").cast("long")
        counted = calibration.groupBy(*keys).agg(F.sum(rejected).alias("adjusted_calibration_rejection_count"))
        rows = rows.join(counted, list(keys), "left").withColumn("systematic_calibration_failure", F.col("adjusted_calibration_rejection_count") > 0)
    for x in PRIMARY_SCORES:
        rows = rows.withColumn(f"rank_{x}", risk.average_rank(F.round(f"mean_{x}", 15), *within))
    rows = rows.withColumn("average_primary_score_rank", sum((F.col(f"rank_{x}") for x in PRIMARY_SCORES), F.lit(0.0)) / len(PRIMARY_SCORES))
    return rows.withColumn("overall_rank", risk.average_rank(F.round("average_primary_score_rank", 12), *within))


def log_score_pairs(scores: DataFrame, pairs: list[tuple[str, str, str]], forecaster: str = "model_id") -> DataFrame:
    """pairs: (group, first, second) -> mean copula log scores and their difference, second less first; the dates of both must
    be the same."""
    table = scores.sparkSession.createDataFrame(
        [(g, m, s) for g, a, b in pairs for m, s in ((a, "first"), (b, "second"))], f"pair string, {forecaster} string, side string"
    )
    rows = scores.select(forecaster, "date", "copula_log_score").join(table, forecaster)
    by_date = rows.groupBy("pair", "date").agg(*[F.max(F.when(F.col("side") == s, F.col("copula_log_score"))).alias(s) for s in ("first", "second")], F.count("*").alias("n"))
    require_none(by_date.where("n <> 2"), "dates of copula log scores differ")
    out = by_date.groupBy("pair").agg(F.count("*").alias("days"), F.avg("first").alias("mean_first"), F.avg("second").alias("mean_second"), F.avg(F.col("second") - F.col("first")).alias("mean_second_minus_first"))
    direction = F.when(F.col("mean_second_minus_first") > 0, "second_higher").when(F.col("mean_second_minus_first") < 0, "first_higher").otherwise("equal")
    return out.withColumns({"direction": direction, "inference_role": F.lit("descriptive")})


def copula_support(tests: DataFrame) -> DataFrame:
    """One row: full support where every test favours the model, partial where one does and none the baseline, else none."""
    row = tests.agg(F.count("*").alias("tests"), F.count_if("favours_model").alias("for_model"), F.count_if("favours_baseline").alias("for_baseline"))
    status = F.when(F.col("for_model") == F.col("tests"), "full_support").when((F.col("for_model") > 0) & (F.col("for_baseline") == 0), "partial_support")
    return row.withColumn("status", status.otherwise("no_support"))


def integrated_support(summary: DataFrame, model: str = "M4", vine_eligible: bool = True) -> DataFrame:
    """One row: supported where ``model`` alone has the first rank, no adjusted rejection and an eligible vine; the best
    eligible model is that of the lowest rank among those without rejections, by name if equal."""
    lowest = summary.agg(F.min("average_primary_score_rank").alias("lowest"))
    rows = summary.join(lowest)
    eligible = ~F.col("systematic_calibration_failure") & ((F.col("model_id") != model) | F.lit(vine_eligible))
    out = rows.agg(
        F.sort_array(F.collect_list(F.when(F.col("average_primary_score_rank") == F.col("lowest"), F.col("model_id")))).alias("unique_first_rank_models"),
        F.bool_or(F.when(F.col("model_id") == model, F.col("systematic_calibration_failure"))).alias("calibration_failure"),
        F.min(F.when(eligible, F.struct("average_primary_score_rank", "model_id"))).alias("best"),
    )
    supported = (F.col("unique_first_rank_models") == F.array(F.lit(model))) & ~F.col("calibration_failure") & F.lit(vine_eligible)
    return out.select(F.when(supported, "supported").otherwise("not_supported").alias("status"), "unique_first_rank_models", "calibration_failure", F.lit(vine_eligible).alias("vine_eligible"), F.col("best.model_id").alias("best_eligible_model"))


def gap_support(bootstrap: dict) -> str:
    """A positive mean gap with a strictly positive lower limit of its interval."""
    return "supported" if bootstrap["mean"] > 0 and bootstrap["lower"] > 0 else "not_supported"


def stable_value(value: Column) -> Column:
    """A value as text that equal values share: arrays, structs and maps as JSON, dates in ISO form, nulls as one text."""
    return F.coalesce(F.to_json(F.struct(value.alias("v"))), F.lit("null"))


REFIT_KEYS = ("year", "month", "universe_variant", "model_id", "grouping_id")


def refit_frame(frame: DataFrame, models: dict[str, str], level: int, name: str) -> DataFrame:
    """Refits of exactly ``models`` with their groupings, one a model and month, of one truncation level."""
    require_unique(frame, ["year", "month", "model_id"], f"{name} refits")
    grouping = F.create_map(*[F.lit(x) for pair in models.items() for x in pair])
    require_none(frame.where(~F.col("grouping_id").eqNullSafe(F.try_element_at(grouping, F.col("model_id")))), f"{name} refits: model or grouping")
    require_none(frame.where(F.col("truncation_level") != level), f"{name} refits: truncation level")
    found = frame.select("model_id").distinct().count()
    if found != len(models):
        raise ConstraintError(f"{name} refits: {found} models, not {len(models)}")
    return frame


def pair_count(dimension: Column, truncation: Column) -> Column:
    """Pair copulas of the first trees of a vine: sum of dimension - tree."""
    return F.aggregate(F.sequence(F.lit(1), truncation.cast("int")), F.lit(0), lambda a, k: a + dimension.cast("int") - k)


def refit_identity(primary: DataFrame, full: DataFrame, columns: list[str], models: dict[str, str], levels: tuple[int, int]) -> DataFrame:
    """One row of totals, if both fits have the same months with the same information sets and each its number of pairs."""
    sides = [refit_frame(primary, models, levels[0], "primary"), refit_frame(full, models, levels[1], "full")]
    for side in sides:
        require_none(side.where(F.col("pair_count") != pair_count(F.col("dimension"), F.col("truncation_level"))), "pair counts")
    a, b = (
        side.select(*REFIT_KEYS, *[stable_value(F.col(c)).alias(f"{n}_{c}") for c in columns], F.col("pair_count").alias(f"{n}_pairs"), F.lit(True).alias(f"in_{n}"))
        for n, side in zip("ab", sides)
    )
    both = a.join(b, list(REFIT_KEYS), "full_outer")
    require_none(both.where("in_a is null or in_b is null").select(*REFIT_KEYS), "refits of one fit only")
    names = F.array_compact(F.array(*[F.when(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(c)) for c in columns]))
    require_none(both.select(*REFIT_KEYS, names.alias("differing")).where("size(differing) > 0"), "information sets")
    return both.agg(F.count("*").alias("matched_refit_count"), F.sum("a_pairs").alias("primary_pair_count_total"), F.sum("b_pairs").alias("full_pair_count_total"))


def fit_complexity(refits: DataFrame, label: str) -> DataFrame:
    """One row: parameters and information criteria of the accepted refits."""
    accepted = refits.where(~F.col("whole_vine_fallback"))
    bad = ~finite(F.col("number_parameters").cast("double")) | ~finite(F.col("aic")) | ~finite(F.col("bic"))
    require_none(accepted.where(bad).select("model_id"), f"{label}: fit diagnostics")
    n = F.col("number_parameters").cast("double")
    return accepted.agg(
        F.lit(label).alias("fit"), F.count("*").alias("accepted_refits"), F.avg(n).alias("mean_number_parameters"), F.median(n).alias("median_number_parameters"),
        F.min(n).alias("minimum_number_parameters"), F.max(n).alias("maximum_number_parameters"), F.avg("aic").alias("mean_aic"), F.avg("bic").alias("mean_bic"),
    )


def window_issues(forecasts: DataFrame, windows: DataFrame, expected: int, least: int = 700, tolerance: float = 1e-12) -> list[str]:
    """Codes of what is wrong with rolling forecasts and the windows they were made from, in a fixed order."""
    rows = forecasts.agg(
        F.count("*").alias("n"),
        F.countDistinct("date").alias("dates"),
        F.countDistinct("date", "model_id").alias("keys"),
        F.countDistinct("refit_id").alias("refits"),
        F.count_if(~(finite(F.col("var_95")) & finite(F.col("var_975")) & finite(F.col("var_99")) & finite(F.col("es_975")) & finite(F.col("realised_loss")))).alias("nonfinite"),
        F.count_if((F.col("var_95") > F.col("var_975")) | (F.col("var_975") > F.col("var_99"))).alias("order"),
        F.count_if(F.col("es_975") < F.col("var_975")).alias("below"),
        F.count_if(_sign_error() > tolerance).alias("sign"),
    ).first()
    seen = windows.agg(F.count("*").alias("n"), F.countDistinct("refit_id").alias("refits"), F.min("training_observations").alias("least"), F.count_if(F.col("training_end") >= F.col("forecast_date")).alias("ahead")).first()
    unbound = windows.select("refit_id").exceptAll(forecasts.select("refit_id")).count() + forecasts.select("refit_id").exceptAll(windows.select("refit_id")).count()
    tests = (
        (rows.n != expected or rows.dates != expected, "incomplete_coverage"),
        (rows.n != rows["keys"] or rows.n != rows.refits, "duplicate_forecast"),
        (seen.n != seen.refits or unbound > 0, "invalid_window_binding"),
        (rows.nonfinite > 0, "nonfinite_forecast"),
        (rows.order > 0, "nonmonotone_var"),
        (rows.below > 0, "es_below_var"),
        (rows.sign > 0, "loss_identity_failed"),
        ((seen.least or 0) < least, "insufficient_training"),
        (seen.ahead > 0, "training_lookahead"),
    )
    return [code for bad, code in tests if bad]


def historical_record(rolled: DataFrame, losses: DataFrame, grouping_id: str = "none", years: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rolling forecasts in the forecast record, and one window record each. rolled: of ``risk.rolling_forecasts``; losses:
    what they were made from."""
    refit = F.concat_ws(":", "model_id", F.date_format("date", "yyyy-MM-dd"))
    rows = rolled.withColumn("refit_id", refit)
    empty = {"seed_components": "array<bigint>", "copula_log_score": "double"}
    forecasts = rows.withColumns(
        {"grouping_id": F.lit(grouping_id), "realised_simple_return": -F.col("realised_loss"), "margin_fallback_count": F.lit(0), "whole_vine_fallback": F.lit(False), "forecast_status": F.lit("ok")}
        | {c: F.lit(None).cast(t) for c, t in empty.items()}
    ).select(*FORECAST_COLUMNS)
    order = Window.partitionBy("model_id").orderBy("date")
    ends = losses.where("loss is not null").select("model_id", F.to_date("date").alias("date"), F.lag("date").over(order).alias("training_end"))
    windows = rows.join(ends, ["model_id", "date"]).select(
        "refit_id", "model_id", F.col("date").alias("forecast_date"), F.add_months("date", -12 * years).alias("window_start"), "training_end", F.col("observations").alias("training_observations")
    )
    return forecasts, windows


def portfolio_rolling(backcasts: DataFrame, years: int = 3, least: int = 700) -> DataFrame:
    """backcasts (portfolio_id, evaluation_year, date, simple_return): each evaluation year has a training series of its own, so
    its days are forecast from that one only."""
    name = F.concat_ws("|", "portfolio_id", F.col("evaluation_year").cast("string"))
    rolled = risk.rolling_forecasts(backcasts.select(name.alias("model_id"), "date", (-F.col("simple_return")).alias("loss")), years, least)
    parts = F.split("model_id", r"\|(?=[0-9]+$)")
    rows = rolled.withColumns({"portfolio_id": parts[0], "evaluation_year": parts[1].cast("int")})
    return rows.where(F.year("date") == F.col("evaluation_year")).drop("model_id")


def evaluate(rows: DataFrame, family: Family, pairs: list[tuple[str, str]], years: tuple[int, int] | None = None, levels: tuple[str, ...] = LEVELS) -> dict[str, DataFrame]:
    """A whole family: checked forecasts to scores, calibration, accuracy tests, and summaries with ranks."""
    scores = scored(checked(rows, family, years))
    if "truncation_level" in family.keys:
        scores = scores.withColumn("variant_id", F.concat_ws("_tree_", "model_id", F.col("truncation_level").cast("string")))
    forecaster = "variant_id" if "truncation_level" in family.keys else "model_id"
    keys = ("variant_id",) if forecaster == "variant_id" else family.keys
    within = ("portfolio_id",) if "portfolio_id" in family.keys else ()
    adjusted = family.calibration_tests is not None
    calibration = calibration_family(scores, keys, levels, family.calibration_tests) if adjusted else annual_calibration(scores.withColumn("date", F.col("date")), keys, levels)
    return {
        "scores": scores,
        "calibration": calibration,
        "annual_calibration": annual_calibration(scores, keys, levels),
        "accuracy": accuracy_family(scores, pairs, family, forecaster=forecaster),
        "summaries": summaries(scores, calibration if adjusted else None, keys, within),
    }
