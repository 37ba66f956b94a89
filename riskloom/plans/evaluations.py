"""Queries of the evaluation families over the driver's tables, with their DuckDB SQL.

Rolling forecasts of the five regions stand in for models; all are scored against AFRICA's realised loss, on the dates that
all five have. Further families scale them by fixed factors.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import risk
from ..sources import views as v
from .oracles import FORECASTS, _ll
from .oracles import erfc as _erfc

RISK = ("var_95", "var_975", "var_99", "es_975")
#: (model or variant, portfolio, truncation level, region, factor) of each family.
MEMBERS = {
    "core": [("M0", None, None, "AFRICA", 1.0), ("M1", None, None, "AMERICA", 1.0), ("M2", None, None, "ASIA", 1.0), ("M3", None, None, "EUROPE", 1.0), ("M4", None, None, "MIDDLE EAST", 1.0)],
    "ml": [("M5", None, None, "AMERICA", 0.97), ("M6", None, None, "ASIA", 0.98), ("M7", None, None, "EUROPE", 1.02), ("M8", None, None, "MIDDLE EAST", 1.03)],
    "current_composition": [("M0", None, None, "AFRICA", 1.0), ("M0_CC", None, None, "ASIA", 1.0)],
    "full_vine": [(m, None, t, r, f) for m, r in (("M2", "ASIA"), ("M4", "MIDDLE EAST")) for t, f in ((3, 1.0), (10, 1.01))],
    "group_balanced": [
        ("B0", "gics", None, "AFRICA", 1.0), ("B1", "gics", None, "AMERICA", 1.0), ("B2", "gics", None, "ASIA", 1.0),
        ("B3", "hierarchical", None, "EUROPE", 1.0), ("B4", "hierarchical", None, "MIDDLE EAST", 1.0), ("B5", "hierarchical", None, "AFRICA", 1.02),
    ],
}
FAMILIES = {
    "core": ev.CORE,
    "ml": ev.ML,
    "current_composition": ev.COMPOSITION,
    "full_vine": ev.FULL_VINE,
    "group_balanced": replace(ev.BALANCED, models={"B0": "none", "B1": "gics", "B2": "gics", "B3": "none", "B4": "hierarchical", "B5": "hierarchical"}, historical=frozenset({"B0", "B3"})),
}
PAIRS = {
    "core": [("M2", "M1"), ("M4", "M3")],
    "ml": [("M5", "M1"), ("M5", "M3"), ("M6", "M2"), ("M6", "M4"), ("M7", "M1"), ("M7", "M3"), ("M8", "M2"), ("M8", "M4")],
    "current_composition": [("M0_CC", "M0")],
    "full_vine": [("M2_tree_10", "M2_tree_3"), ("M4_tree_10", "M4_tree_3")],
    "group_balanced": [("B2", "B1"), ("B5", "B4")],
}


def family_forecasts(s, d, name: str) -> DataFrame:
    family, members = FAMILIES[name], MEMBERS[name]
    rolled = risk.rolling_forecasts(v.region_losses(s, d))
    days = rolled.groupBy("date").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("model_id") == "AFRICA", F.col("realised_loss"))).alias("realised_loss"),
        F.map_from_entries(F.collect_list(F.struct("model_id", F.struct(*RISK)))).alias("by_region"),
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model_id"), F.lit(p).cast("string").alias("portfolio_id"), F.lit(t).cast("int").alias("truncation_level"), F.lit(f).alias("factor"), F.col("by_region")[r].alias("x"))
        for m, p, t, r, f in members
    ]))
    out = days.where("n = 5").select("date", "realised_loss", rows.alias("m"))
    historical = F.col("m.model_id").isin(*family.historical) if family.historical else F.lit(False)
    grouping = F.create_map(*[F.lit(x) for pair in family.models.items() for x in pair])
    columns = {
        "date": F.col("date"),
        "model_id": F.col("m.model_id"),
        "grouping_id": grouping[F.col("m.model_id")],
        "refit_id": F.concat_ws(":", F.col("m.model_id"), F.date_format("date", "yyyy-MM")),
        **{c: F.col(f"m.x.{c}") * F.col("m.factor") for c in RISK},
        "realised_simple_return": -F.col("realised_loss"),
        "realised_loss": F.col("realised_loss"),
        "seed_components": F.when(~historical, F.array(F.lit(5110), F.year("date"), F.month("date")).cast("array<bigint>")),
        "margin_fallback_count": F.lit(0),
        "whole_vine_fallback": F.lit(False),
        "forecast_status": F.lit("ok"),
        "copula_log_score": F.when(~historical, F.col("m.x.var_95") * F.col("m.factor") * 10),
    }
    extra = {"portfolio_id": F.col("m.portfolio_id"), "truncation_level": F.col("m.truncation_level")}
    return out.select(*[c.alias(n) for n, c in (columns | {k: extra[k] for k in family.keys if k in extra}).items()])


def _scores(s, d, name: str, check: bool = False) -> DataFrame:
    rows = family_forecasts(s, d, name)
    scores = ev.scored(ev.checked(rows, FAMILIES[name]) if check else rows)
    if name == "full_vine":
        scores = scores.withColumn("variant_id", F.concat_ws("_tree_", "model_id", F.col("truncation_level").cast("string")))
    return scores


def _keys(name: str) -> tuple[str, ...]:
    return ("variant_id",) if name == "full_vine" else FAMILIES[name].keys


def _forecaster(name: str) -> str:
    return "variant_id" if name == "full_vine" else "model_id"


def _round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items() if c in df.columns})


def _calibration(name: str):
    def query(s, d):
        rows = ev.calibration_family(_scores(s, d, name), _keys(name), tests=FAMILIES[name].calibration_tests)
        keep = [*_keys(name), "level", "days", "exceptions", "exception_rate", "lr_uc", "p_uc", "lr_ind", "p_ind", "p_cc", "n00", "n01", "n10", "n11", "p_uc_holm", "p_ind_holm", "reject_uc", "reject_ind"]
        return _round(rows.select(*keep), {"exception_rate": 8, "lr_uc": 6, "lr_ind": 6, "p_uc": 6, "p_ind": 6, "p_cc": 6, "p_uc_holm": 5, "p_ind_holm": 5})

    return query


def _annual(name: str):
    def query(s, d):
        rows = ev.annual_calibration(_scores(s, d, name), _keys(name))
        keep = [*_keys(name), "year", "level", "days", "exceptions", "exception_rate", "p_uc", "p_ind", "p_cc"]
        return _round(rows.select(*keep), {"exception_rate": 8, "p_uc": 6, "p_ind": 6, "p_cc": 6})

    return query


def _accuracy_rows(s, d, name: str) -> DataFrame:
    scores = _scores(s, d, name)
    if name == "ml":
        core = ev.scored(family_forecasts(s, d, "core")).where("model_id <> 'M0'")
        scores = scores.unionByName(core)
    return ev.accuracy_family(scores, PAIRS[name], FAMILIES[name], forecaster=_forecaster(name))


def _accuracy(name: str):
    def query(s, d):
        adjusted = "p_holm" if FAMILIES[name].adjustment == "holm" else "p_bh"
        keep = ["model_id", "baseline_id", "score", "days", "mean_difference", "dm_statistic", "p_value", adjusted, "direction", "favours_model", "favours_baseline"]
        return _round(_accuracy_rows(s, d, name).select(*keep), {"mean_difference": 8, "dm_statistic": 5, "p_value": 5, adjusted: 5})

    return query


def _summary_rows(s, d, name: str) -> DataFrame:
    scores, keys = _scores(s, d, name), _keys(name)
    within = ("portfolio_id",) if "portfolio_id" in keys else ()
    tests = FAMILIES[name].calibration_tests
    return ev.summaries(scores, ev.calibration_family(scores, keys, tests=tests) if tests else None, keys, within)


def _summaries(name: str):
    def query(s, d):
        keep = [*_keys(name), "observations", "mean_quantile_loss_95", "mean_quantile_loss_99", "mean_fz0_975", "mean_copula_log_score", "exceptions_95", "exceptions_99", "average_primary_score_rank", "overall_rank"]
        keep += ["adjusted_calibration_rejection_count"] if FAMILIES[name].calibration_tests else []
        return _round(_summary_rows(s, d, name).select(*keep), {"mean_quantile_loss_95": 8, "mean_quantile_loss_99": 8, "mean_fz0_975": 6, "mean_copula_log_score": 7, "average_primary_score_rank": 6})

    return query


def core_forecast_problems(s, d):
    """Codes of broken rules in forecasts that are spoilt by date: every seventh day has a wrong sign, every eleventh an
    expected shortfall below the value at risk, every thirteenth an unknown status."""
    rows = family_forecasts(s, d, "core")
    day = F.dayofyear("date")
    rows = rows.withColumns(
        {
            "realised_loss": F.when(day % 7 == 0, F.col("realised_loss") + 1).otherwise(F.col("realised_loss")),
            "es_975": F.when(day % 11 == 0, F.col("var_975") - 0.001).otherwise(F.col("es_975")),
            "forecast_status": F.when(day % 13 == 0, F.lit("failed")).otherwise(F.col("forecast_status")),
            "copula_log_score": F.when(day % 17 == 0, F.lit(0.0)).otherwise(F.col("copula_log_score")),
        }
    )
    return ev.forecast_problems(rows, ev.CORE)


def ml_log_scores(s, d):
    rows = ev.log_score_pairs(_scores(s, d, "ml"), [("spectral", "M5", "M6"), ("pca_kmeans", "M7", "M8")])
    return _round(rows, {"mean_first": 7, "mean_second": 7, "mean_second_minus_first": 7})


def hypothesis_copula(s, d):
    return ev.copula_support(_accuracy_rows(s, d, "core"))


def hypothesis_integrated(s, d):
    return ev.integrated_support(_summary_rows(s, d, "core")).withColumn("unique_first_rank_models", F.concat_ws(",", "unique_first_rank_models"))


def rolling_by_portfolio(s, d):
    """Two portfolios of region returns, each with a training series for each evaluation year."""
    rows = v.region_returns(s, d).where("simple_return is not null")
    books = rows.where("security in ('AFRICA', 'AMERICA')").select(F.col("security").alias("portfolio_id"), "date", (F.col("simple_return") / 100).alias("simple_return"))
    years = books.withColumn("evaluation_year", F.explode(F.array(F.lit(1999), F.lit(2000), F.lit(2001)))).where("year(date) <= evaluation_year and year(date) >= evaluation_year - 4")
    found = ev.portfolio_rolling(years.withColumn("simple_return", F.col("simple_return") * (F.col("evaluation_year") - 1990) / 10))
    return _round(found, {"var_95": 6, "var_975": 6, "var_99": 6, "es_975": 6, "realised_loss": 6})


def queries() -> dict:
    out = {f.__name__: f for f in (core_forecast_problems, ml_log_scores, hypothesis_copula, hypothesis_integrated, rolling_by_portfolio)}
    for name, family in FAMILIES.items():
        if family.calibration_tests:
            out[f"{name}_calibration"] = _calibration(name)
        out[f"{name}_accuracy"] = _accuracy(name)
        out[f"{name}_summaries"] = _summaries(name)
    out["core_annual_calibration"], out["ml_annual_calibration"] = _annual("core"), _annual("ml")
    return out


def _members(name: str) -> str:
    family = FAMILIES[name]
    text = lambda x: "NULL" if x is None else f"'{x}'"
    rows = ", ".join(
        f"({text(m)}, CAST({text(p)} AS VARCHAR), {text(m + '_tree_' + str(t) if t else m)}, {text(r)}, CAST({f} AS DOUBLE), {str(m in family.historical).lower()}, {text(family.models.get(m))})"
        for m, p, t, r, f in MEMBERS[name]
    )
    return f"members_{name}(model_id, portfolio_id, forecaster, region, factor, historical, grouping_id) AS (VALUES {rows})"


def _scored_sql(name: str) -> str:
    f = f"fc_{name}"
    return f"""{_members(name)},
{f} AS (SELECT m.model_id, m.portfolio_id, m.forecaster, m.historical, w.date, f.var_95 * m.factor AS var_95, f.var_975 * m.factor AS var_975, f.var_99 * m.factor AS var_99, f.es_975 * m.factor AS es_975,
        a.realised_loss, CASE WHEN NOT m.historical THEN f.var_95 * m.factor * 10 END AS copula_log_score
        FROM (SELECT date FROM forecasts GROUP BY date HAVING count(*) = 5) w JOIN forecasts a ON a.date = w.date AND a.model_id = 'AFRICA' CROSS JOIN members_{name} m JOIN forecasts f ON f.date = w.date AND f.model_id = m.region),
scores_{name} AS (SELECT *, (CAST(0.95 AS DOUBLE) - CASE WHEN realised_loss < var_95 THEN 1 ELSE 0 END) * (realised_loss - var_95) AS quantile_loss_95,
         (CAST(0.99 AS DOUBLE) - CASE WHEN realised_loss < var_99 THEN 1 ELSE 0 END) * (realised_loss - var_99) AS quantile_loss_99,
         CASE WHEN realised_loss > var_975 THEN realised_loss - var_975 ELSE 0 END / ((1 - CAST(0.975 AS DOUBLE)) * es_975) + var_975 / es_975 + ln(es_975) - 1 AS fz0_975,
         realised_loss > var_95 AS exception_95, realised_loss > var_99 AS exception_99 FROM {f})"""


def _calibration_sql(name: str, annual: bool = False) -> str:
    year = "CAST(year(date) AS INTEGER)" if annual else "0"
    by = "forecaster, portfolio_id, model_id, y, level"
    together = _ll("(n01 + n11)", "(n00 + n01 + n10 + n11)", "((n01 + n11) / CAST(n00 + n01 + n10 + n11 AS DOUBLE))")
    p01, p11 = "(CASE WHEN n00 + n01 > 0 THEN n01 / CAST(n00 + n01 AS DOUBLE) ELSE 0 END)", "(CASE WHEN n10 + n11 > 0 THEN n11 / CAST(n10 + n11 AS DOUBLE) ELSE 0 END)"
    apart = f"{_ll('n01', '(n00 + n01)', p01)} + {_ll('n11', '(n10 + n11)', p11)}"
    return f"""{_scored_sql(name)},
hits AS (SELECT forecaster, portfolio_id, model_id, {year} AS y, date, CAST(0.95 AS DOUBLE) AS level, CAST(exception_95 AS INTEGER) AS hit FROM scores_{name}
         UNION ALL SELECT forecaster, portfolio_id, model_id, {year}, date, CAST(0.99 AS DOUBLE), CAST(exception_99 AS INTEGER) FROM scores_{name}),
steps AS (SELECT *, lag(hit) OVER (PARTITION BY {by} ORDER BY date) AS p FROM hits),
counted AS (SELECT {by}, count(*) AS days, CAST(sum(hit) AS BIGINT) AS exceptions, count(*) FILTER (WHERE p = 0 AND hit = 0) AS n00, count(*) FILTER (WHERE p = 0 AND hit = 1) AS n01,
            count(*) FILTER (WHERE p = 1 AND hit = 0) AS n10, count(*) FILTER (WHERE p = 1 AND hit = 1) AS n11 FROM steps GROUP BY ALL),
ratios AS (SELECT *, greatest(0, -2 * ({_ll('exceptions', 'days', '(1 - level)')} - {_ll('exceptions', 'days', '(exceptions / CAST(days AS DOUBLE))')})) AS lr_uc,
           greatest(0, -2 * ({together} - ({apart}))) AS lr_ind FROM counted),
tested AS (SELECT *, {_erfc('sqrt(lr_uc / 2)')} AS p_uc, {_erfc('sqrt(lr_ind / 2)')} AS p_ind, exp(-(lr_uc + lr_ind) / 2) AS p_cc FROM ratios),
long AS (SELECT {by}, 'uc' AS test, p_uc AS p FROM tested UNION ALL SELECT {by}, 'ind', p_ind FROM tested),
ordered AS (SELECT *, row_number() OVER (ORDER BY p, {by}, test) AS i, count(*) OVER () AS m FROM long),
holm AS (SELECT *, max(least(1, (m - i + 1) * p)) OVER (ORDER BY i) AS q FROM ordered),
calibrated AS (SELECT t.*, a.q AS p_uc_holm, b.q AS p_ind_holm, a.q < 0.05 AS reject_uc, b.q < 0.05 AS reject_ind FROM tested t JOIN holm a ON a.forecaster = t.forecaster AND a.level = t.level AND a.y = t.y AND a.test = 'uc'
               JOIN holm b ON b.forecaster = t.forecaster AND b.level = t.level AND b.y = t.y AND b.test = 'ind')"""


def _key_sql(name: str) -> str:
    return {"full_vine": "forecaster AS variant_id", "group_balanced": "portfolio_id, model_id"}.get(name, "model_id")


def _accuracy_sql(name: str) -> str:
    sources = [name, "core"] if name == "ml" else [name]
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS[name])
    m = len(PAIRS[name]) * 3
    long = " UNION ALL ".join(f"SELECT forecaster, date, '{x}' AS score, {x} AS loss FROM scores_{n}" for n in sources for x in ev.PRIMARY_SCORES)
    lags = ", ".join(f"lag(c, {k}) OVER (PARTITION BY model_id, baseline_id, score ORDER BY date) AS c{k}" for k in range(1, 8))
    bartlett = "".join(f" + 2 * (1 - {k} / 8.0) * coalesce(sum(c * c{k}), 0)" for k in range(1, 8))
    holm = FAMILIES[name].adjustment == "holm"
    column = "p_holm" if holm else "p_bh"
    adjusted = f"max(least(1, ({m} - i + 1) * p_value)) OVER (ORDER BY i)" if holm else f"least(1, min(p_value * {m} / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    return f"""{', '.join(_scored_sql(n) for n in sources)},
pairs(model_id, baseline_id) AS (VALUES {pairs}), losses_long AS ({long}),
d AS (SELECT p.model_id, p.baseline_id, a.score, a.date, a.loss - b.loss AS d FROM pairs p JOIN losses_long a ON a.forecaster = p.model_id JOIN losses_long b ON b.forecaster = p.baseline_id AND b.date = a.date AND b.score = a.score),
c AS (SELECT *, d - avg(d) OVER (PARTITION BY model_id, baseline_id, score) AS c FROM d), l AS (SELECT *, {lags} FROM c),
g AS (SELECT model_id, baseline_id, score, count(*) AS days, avg(d) AS mean_difference, (sum(c * c){bartlett}) / count(*) AS v FROM l GROUP BY 1, 2, 3),
z AS (SELECT *, mean_difference / sqrt(v / days) AS dm_statistic FROM g), pv AS (SELECT *, {_erfc('abs(dm_statistic) / sqrt(2)')} AS p_value FROM z),
o AS (SELECT *, row_number() OVER (ORDER BY p_value, model_id, baseline_id, score) AS i FROM pv), adj AS (SELECT *, {adjusted} AS {column} FROM o),
acc AS (SELECT *, CASE WHEN mean_difference < 0 THEN 'model_lower_loss' WHEN mean_difference > 0 THEN 'baseline_lower_loss' ELSE 'equal_loss' END AS direction,
        {column} < 0.05 AND mean_difference < 0 AS favours_model, {column} < 0.05 AND mean_difference > 0 AS favours_baseline FROM adj)"""


def _summaries_sql(name: str) -> str:
    tests = FAMILIES[name].calibration_tests
    base = _calibration_sql(name) if tests else _scored_sql(name)
    part = "PARTITION BY portfolio_id " if name == "group_balanced" else ""
    also = part.removeprefix("PARTITION BY ").strip()
    same = lambda x: f"PARTITION BY {also + ', ' if also else ''}{x}"
    rank = lambda x: f"(rank() OVER ({part}ORDER BY {x}) + (count(*) OVER ({same(x)}) - 1) / 2.0)"
    rejected = ", rejections AS (SELECT forecaster, CAST(sum(CAST(reject_uc AS INTEGER) + CAST(reject_ind AS INTEGER)) AS BIGINT) AS adjusted_calibration_rejection_count FROM calibrated GROUP BY 1)" if tests else ""
    return f"""{base}{rejected},
means AS (SELECT forecaster, portfolio_id, model_id, count(*) AS observations, avg(quantile_loss_95) AS mean_quantile_loss_95, avg(quantile_loss_99) AS mean_quantile_loss_99, avg(fz0_975) AS mean_fz0_975,
          avg(copula_log_score) AS mean_copula_log_score, CAST(sum(CAST(exception_95 AS INTEGER)) AS BIGINT) AS exceptions_95, CAST(sum(CAST(exception_99 AS INTEGER)) AS BIGINT) AS exceptions_99 FROM scores_{name} GROUP BY ALL),
ranked AS (SELECT *, round(({rank('round(mean_quantile_loss_95, 15)')} + {rank('round(mean_quantile_loss_99, 15)')} + {rank('round(mean_fz0_975, 15)')}) / 3.0, 12) AS average_primary_score_rank FROM means),
summary AS (SELECT *, CAST({rank('average_primary_score_rank')} AS DOUBLE) AS overall_rank FROM ranked{' JOIN rejections USING (forecaster)' if tests else ''})"""


def _rounded_sql(columns: dict[str, int | None]) -> str:
    return ", ".join(c if n is None else f"round({c}, {n}) AS {c}" for c, n in columns.items())


def oracle_sql() -> dict[str, str]:
    out = {}
    full = {"level": None, "days": None, "exceptions": None}
    ps = {"p_uc": 6, "p_ind": 6, "p_cc": 6}
    for name, family in FAMILIES.items():
        if family.calibration_tests:
            columns = _rounded_sql(full | {"lr_uc": 6, "lr_ind": 6} | ps | dict.fromkeys(("n00", "n01", "n10", "n11")) | {"p_uc_holm": 5, "p_ind_holm": 5, "reject_uc": None, "reject_ind": None})
            out[f"{name}_calibration"] = f"WITH {FORECASTS}, {_calibration_sql(name)} SELECT {_key_sql(name)}, {columns}, round(exceptions / CAST(days AS DOUBLE), 8) AS exception_rate FROM calibrated"
        column = "p_holm" if family.adjustment == "holm" else "p_bh"
        columns = _rounded_sql({"model_id": None, "baseline_id": None, "score": None, "days": None, "mean_difference": 8, "dm_statistic": 5, "p_value": 5, column: 5, "direction": None, "favours_model": None, "favours_baseline": None})
        out[f"{name}_accuracy"] = f"WITH {FORECASTS}, {_accuracy_sql(name)} SELECT {columns} FROM acc"
        columns = {"observations": None, "mean_quantile_loss_95": 8, "mean_quantile_loss_99": 8, "mean_fz0_975": 6, "mean_copula_log_score": 7, "exceptions_95": None, "exceptions_99": None, "overall_rank": None}
        columns |= {"adjusted_calibration_rejection_count": None} if family.calibration_tests else {}
        out[f"{name}_summaries"] = f"WITH {FORECASTS}, {_summaries_sql(name)} SELECT {_key_sql(name)}, {_rounded_sql(columns)}, round(CAST(average_primary_score_rank AS DOUBLE), 6) AS average_primary_score_rank FROM summary"
    for name in ("core", "ml"):
        out[f"{name}_annual_calibration"] = f"WITH {FORECASTS}, {_calibration_sql(name, True)} SELECT model_id, y AS year, {_rounded_sql(full | ps)}, round(exceptions / CAST(days AS DOUBLE), 8) AS exception_rate FROM tested"
    out["core_forecast_problems"] = f"""WITH {FORECASTS}, {_scored_sql('core')}, spoilt AS (SELECT *, dayofyear(date) % 7 = 0 AS sign, dayofyear(date) % 11 = 0 AS below, dayofyear(date) % 13 = 0 AS failed, dayofyear(date) % 17 = 0 AS score FROM fc_core)
        SELECT 'loss_identity' AS code, model_id, date FROM spoilt WHERE sign UNION ALL SELECT 'es_below_var', model_id, date FROM spoilt WHERE below UNION ALL SELECT 'unsupported_status', model_id, date FROM spoilt WHERE failed
        UNION ALL SELECT 'copula_score', model_id, date FROM spoilt WHERE score AND historical"""
    out["ml_log_scores"] = f"""WITH {FORECASTS}, {_scored_sql('ml')}, p AS (SELECT CASE WHEN model_id IN ('M5', 'M6') THEN 'spectral' ELSE 'pca_kmeans' END AS pair, date, max(CASE WHEN model_id IN ('M5', 'M7') THEN copula_log_score END) AS a, max(CASE WHEN model_id IN ('M6', 'M8') THEN copula_log_score END) AS b FROM scores_ml GROUP BY 1, 2)
        SELECT pair, count(*) AS days, round(avg(a), 7) AS mean_first, round(avg(b), 7) AS mean_second, round(avg(b - a), 7) AS mean_second_minus_first,
        CASE WHEN avg(b - a) > 0 THEN 'second_higher' WHEN avg(b - a) < 0 THEN 'first_higher' ELSE 'equal' END AS direction, 'descriptive' AS inference_role FROM p GROUP BY 1"""
    out["hypothesis_copula"] = f"""WITH {FORECASTS}, {_accuracy_sql('core')}, k AS (SELECT count(*) AS tests, count(*) FILTER (WHERE favours_model) AS for_model, count(*) FILTER (WHERE favours_baseline) AS for_baseline FROM acc)
        SELECT *, CASE WHEN for_model = tests THEN 'full_support' WHEN for_model > 0 AND for_baseline = 0 THEN 'partial_support' ELSE 'no_support' END AS status FROM k"""
    out["hypothesis_integrated"] = f"""WITH {FORECASTS}, {_summaries_sql('core')}, x AS (SELECT *, min(average_primary_score_rank) OVER () AS low FROM summary),
        k AS (SELECT string_agg(CASE WHEN average_primary_score_rank = low THEN model_id END, ',' ORDER BY model_id) AS unique_first_rank_models, bool_or(model_id = 'M4' AND adjusted_calibration_rejection_count > 0) AS calibration_failure FROM x)
        SELECT CASE WHEN unique_first_rank_models = 'M4' AND NOT calibration_failure THEN 'supported' ELSE 'not_supported' END AS status, unique_first_rank_models, calibration_failure, true AS vine_eligible,
        (SELECT model_id FROM summary WHERE adjusted_calibration_rejection_count = 0 ORDER BY average_primary_score_rank, model_id LIMIT 1) AS best_eligible_model FROM k"""
    returns = FORECASTS[: FORECASTS.index(",\nlosses AS")]
    out["rolling_by_portfolio"] = f"""WITH {returns}, book AS (SELECT security AS portfolio_id, y AS evaluation_year, date, -(r / 100 * (y - 1990) / 10) AS loss FROM returns CROSS JOIN (VALUES (1999), (2000), (2001)) t(y) WHERE r IS NOT NULL AND security IN ('AFRICA', 'AMERICA') AND year(date) BETWEEN y - 4 AND y),
        win AS (SELECT t.portfolio_id, t.evaluation_year, t.date, t.loss AS realised_loss, w.loss AS x, row_number() OVER (PARTITION BY t.portfolio_id, t.evaluation_year, t.date ORDER BY w.loss) AS k, count(*) OVER (PARTITION BY t.portfolio_id, t.evaluation_year, t.date) AS n
                FROM book t JOIN book w ON w.portfolio_id = t.portfolio_id AND w.evaluation_year = t.evaluation_year AND w.date >= t.date - INTERVAL 3 YEAR AND w.date < t.date WHERE year(t.date) = t.evaluation_year)
        SELECT portfolio_id, evaluation_year, date, CAST(any_value(n) AS INTEGER) AS observations, round(max(CASE WHEN k = ceil(CAST(n AS DOUBLE) * CAST(0.95 AS DOUBLE)) THEN x END), 6) AS var_95,
               round(max(CASE WHEN k = ceil(CAST(n AS DOUBLE) * CAST(0.975 AS DOUBLE)) THEN x END), 6) AS var_975, round(max(CASE WHEN k = ceil(CAST(n AS DOUBLE) * CAST(0.99 AS DOUBLE)) THEN x END), 6) AS var_99,
               round((sum(CASE WHEN k > ceil(CAST(n AS DOUBLE) * CAST(0.975 AS DOUBLE)) THEN x ELSE 0 END) + max(CASE WHEN k = ceil(CAST(n AS DOUBLE) * CAST(0.975 AS DOUBLE)) THEN x * (k - CAST(n AS DOUBLE) * CAST(0.975 AS DOUBLE)) END))
                     / (any_value(CAST(n AS DOUBLE)) * (1 - CAST(0.975 AS DOUBLE))), 6) AS es_975, round(any_value(realised_loss), 6) AS realised_loss FROM win WHERE n >= 700 GROUP BY 1, 2, 3"""
    return out
