"""Whole steps: a portfolio's rolling forecasts with their windows and checks, drifting group portfolios, and what-if reruns.

Each gives tables and a function that audits them (status, issues, counts); nothing is written here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chain, evaluation, portfolio, risk, scenario
from .quality import finite, require_none


def _audited(forecasts: DataFrame, windows: DataFrame, expected: int, least: int) -> dict:
    issues = evaluation.window_issues(forecasts, windows, expected, least)
    counts = windows.agg(F.min("training_observations").alias("least"), F.max("training_observations").alias("most")).first()
    return {"status": "fail" if issues else "pass", "issues": issues, "forecasts": forecasts.count(), "windows": windows.count(), "training_observations": [counts.least, counts.most]}


def historical_simulation(panel: DataFrame, schedule: DataFrame, years: tuple[int, int], least: int = 700, model_id: str = "M0") -> tuple[DataFrame, DataFrame, Callable[[], dict]]:
    """(forecasts, windows, audit) of the equal-weight portfolio of each year's active set, for the dates of the evaluation years. Before the
    first scheduled year the first set is held."""
    first = schedule.agg(F.min("year").alias("first"))
    early = schedule.join(first, F.col("year") == F.col("first")).select("security", "rebalance_date", "first")
    before = panel.select(F.year("date").alias("year")).distinct().join(first, F.col("year") < F.col("first")).select("year").crossJoin(F.broadcast(early.select("security", "rebalance_date")))
    daily = portfolio.equal_weight(panel, schedule.select("year", "security", "rebalance_date").unionByName(before.select("year", "security", "rebalance_date")))
    losses = daily.select(F.lit(model_id).alias("model_id"), "date", (-F.col("simple_return")).alias("loss"))
    rolled = risk.rolling_forecasts(losses, least=least).where(F.year("date").between(*years))
    forecasts, windows = evaluation.historical_record(rolled, losses)
    return forecasts, windows, lambda: _audited(forecasts, windows, losses.where(F.year("date").between(*years)).count(), least)


def current_composition(panel: DataFrame, schedule: DataFrame, years: tuple[int, int], least: int = 700, model_id: str = "M0_CC") -> tuple[DataFrame, DataFrame, Callable[[], dict]]:
    """The same with each evaluation year's set held over its whole training window."""
    own = schedule.where(F.col("year").between(*years))
    books = portfolio.backcast(panel, own).withColumn("portfolio_id", F.lit(model_id))
    return _by_year(books, least)


def balanced_simulation(panel: DataFrame, schedule: DataFrame, assignments: DataFrame, names: dict[str, str], least: int = 700) -> tuple[DataFrame, DataFrame, Callable[[], dict]]:
    """The same for drifting equal-group portfolios: names: grouping_id -> model id; assignments (year, grouping_id, security, group_id)."""
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = balanced_outputs(panel, schedule, assignments)[1].withColumn("portfolio_id", name[F.col("grouping_id")])
    return _by_year(rows.where("portfolio_id is not null").select("portfolio_id", F.col("year").alias("evaluation_year"), "date", "simple_return"), least)


def _by_year(books: DataFrame, least: int) -> tuple[DataFrame, DataFrame, Callable[[], dict]]:
    series = books.select(F.concat_ws("|", "portfolio_id", F.col("evaluation_year").cast("string")).alias("model_id"), "date", (-F.col("simple_return")).alias("loss"))
    rolled = risk.rolling_forecasts(series, least=least)
    parts = F.split("model_id", r"\|(?=[0-9]+$)")
    own = rolled.where(F.year("date") == parts[1].cast("int"))
    forecasts, windows = evaluation.historical_record(own, series)
    named = forecasts.withColumn("model_id", F.split("model_id", r"\|(?=[0-9]+$)")[0])
    return named, windows.withColumn("model_id", F.split("model_id", r"\|(?=[0-9]+$)")[0]), lambda: _several(named, windows, series, least)


def _several(forecasts: DataFrame, windows: DataFrame, series: DataFrame, least: int) -> dict:
    """Audits of each model, put together; a model's dates are those of its own evaluation years."""
    name = F.split("model_id", r"\|(?=[0-9]+$)")
    own_days = series.where(F.year("date") == name[1].cast("int")).groupBy(name[0].alias("model_id")).agg(F.countDistinct("date").alias("n"))
    parts = {}
    for r in own_days.collect():
        own = forecasts.where(F.col("model_id") == r.model_id)
        parts[r.model_id] = _audited(own, windows.join(own.select("refit_id"), "refit_id", "left_semi"), r.n, least)
    issues = sorted({f"{m}:{i}" for m, p in parts.items() for i in p["issues"]})
    return {"status": "fail" if issues or not parts else "pass", "issues": issues, "models": parts}


def return_segment(panel: DataFrame, schedule: DataFrame, assignments: DataFrame, years: int = 3) -> DataFrame:
    """(year, role, grouping_id, security, group_id, date, simple_return) of each year's set with its labels. A security without a label, a
    label without a security, and a return that is missing, not finite, or -1 or less, fail."""
    from . import groupings

    keys = ["year", "security"]
    each = assignments.select("grouping_id").distinct().crossJoin(schedule.select(*keys))
    require_none(each.join(assignments, ["grouping_id", *keys], "left_anti"), "a security has no label")
    require_none(assignments.join(schedule, keys, "left_anti"), "a label without an active security")
    rows = groupings.windows(panel, schedule, years)
    sizes = schedule.groupBy("year").agg(F.count("*").alias("active"))
    days = rows.groupBy("year", "date").agg(F.count_if(finite(F.col("simple_return")) & (F.col("simple_return") > -1)).alias("n")).join(sizes, "year")
    first = panel.agg(F.min("date").alias("first"))
    require_none(days.join(first).where("n < active and not (n = 0 and date = first)"), "an active return is missing or invalid")
    return rows.where("simple_return is not null").join(assignments, keys)


def memberships(labels: DataFrame, *by: str) -> DataFrame:
    """(by, group_id, members): each group's securities in order."""
    return labels.groupBy(*by, "group_id").agg(F.sort_array(F.collect_list("security")).alias("members"))


def balanced_outputs(panel: DataFrame, schedule: DataFrame, assignments: DataFrame, years: int = 3) -> tuple[DataFrame, DataFrame]:
    """(groups, portfolios) of drifting equal-group portfolios, for training and evaluation: groups (grouping_id, year, role, date, group_id,
    group_weight, group_return), portfolios (grouping_id, year, role, date, simple_return, weight_sum). Weights start anew on the first
    date of each calendar year, 1 / (groups * members), and drift until its end."""
    rows = return_segment(panel, schedule, assignments, years)
    members = assignments.groupBy("grouping_id", "year", "group_id").agg(F.count("*").alias("members"))
    count = members.groupBy("grouping_id", "year").agg(F.count("*").alias("groups"))
    started = rows.join(members, ["grouping_id", "year", "group_id"]).join(count, ["grouping_id", "year"]).withColumn("start", 1.0 / (F.col("groups") * F.col("members")))
    by_security = "partition by grouping_id, year, security, year(date) order by date rows between unbounded preceding and 1 preceding"
    grown = started.withColumn("wealth", F.col("start") * F.exp(F.coalesce(F.expr(f"sum(log1p(simple_return)) over ({by_security})"), F.lit(0.0))))
    held = grown.withColumn("weight", F.col("wealth") / F.expr("sum(wealth) over (partition by grouping_id, year, date)"))
    keys = ["grouping_id", "year", "role", "date"]
    groups = held.groupBy(*keys, "group_id").agg(F.sum("weight").alias("group_weight"), (F.sum(F.col("weight") * F.col("simple_return")) / F.sum("weight")).alias("group_return"))
    portfolios = groups.groupBy(*keys).agg(F.sum(F.col("group_weight") * F.col("group_return")).alias("simple_return"), F.sum("group_weight").alias("weight_sum"))
    return groups, portfolios


def annual_samples(groups: DataFrame, grouping_id: str, year: int) -> tuple[DataFrame, DataFrame]:
    """One grouping's and year's training and evaluation rows; both must be there and share no date."""
    own = groups.where((F.col("grouping_id") == grouping_id) & (F.col("year") == year))
    training, evaluated = own.where("role = 'training'"), own.where("role = 'evaluation'")
    require_none(training.join(evaluated.select("date").distinct(), "date", "left_semi"), "training and evaluation share a date")
    for part, name in ((training, "training"), (evaluated, "evaluation")):
        if part.isEmpty():
            raise ValueError(f"{grouping_id} {year}: no {name} rows")
    return training, evaluated


def construction_quality(groups: DataFrame, portfolios: DataFrame, tolerance: float = 1e-12) -> dict:
    """Issues of balanced portfolios: repeated rows, weights that are not positive or do not sum to one, first dates of a calendar year on
    which groups are not equal, returns that are not finite."""
    first = portfolios.groupBy("grouping_id", "year", F.year("date").alias("calendar")).agg(F.min("date").alias("date"), F.count("*").alias("days"))
    count = groups.groupBy("grouping_id", "year", "date").agg(F.count("*").alias("groups"))
    starts = groups.join(first.drop("calendar", "days"), ["grouping_id", "year", "date"]).join(count, ["grouping_id", "year", "date"])
    g = groups.agg(F.count("*").alias("n"), F.countDistinct("grouping_id", "year", "role", "date", "group_id").alias("keys"), F.count_if(~(F.col("group_weight") > 0)).alias("weight"), F.count_if(~finite(F.col("group_return"))).alias("number")).first()
    p = portfolios.agg(F.count("*").alias("n"), F.countDistinct("grouping_id", "year", "role", "date").alias("keys"), F.count_if(F.abs(F.col("weight_sum") - 1) > tolerance).alias("sum")).first()
    uneven = starts.where(F.abs(F.col("group_weight") - 1.0 / F.col("groups")) > tolerance).count()
    tests = (
        (g.n != g["keys"], "duplicate_group_row"), (p.n != p["keys"], "duplicate_portfolio_row"), (g.weight > 0, "nonpositive_group_weight"),
        (g.number > 0, "nonfinite_group_return"), (p.sum > 0, "weights_do_not_sum_to_one"), (uneven > 0, "unequal_groups_at_reset"),
    )
    issues = [code for bad, code in tests if bad]
    return {"status": "fail" if issues else "pass", "issues": issues, "group_rows": g.n, "portfolio_rows": p.n, "resets": first.count()}


def scenario_rerun(
    groups: DataFrame, labels: DataFrame, panel: DataFrame, security: str, date, values: dict[str, float], models: dict[str, dict], forecast: Callable[[DataFrame, dict], DataFrame], family: evaluation.Family, pairs: list[tuple[str, str]]
) -> dict[str, dict[str, DataFrame]]:
    """The whole family again under each scenario: scenario -> the tables of ``evaluation.evaluate`` and the differences of its scores from
    the scenario named primary, which must be among them. models: model_id -> {grouping_id, ...}; forecast(group returns, models of that
    grouping) gives the forecast record. Assignments stay as they are."""
    if "primary" not in values:
        raise ValueError("the primary scenario is missing")
    shocked = scenario.scenario_groups(groups, labels, panel, security, date, values)
    out: dict[str, dict[str, DataFrame]] = {}
    for name in ["primary", *(n for n in values if n != "primary")]:
        rows = None
        for grouping in sorted({m["grouping_id"] for m in models.values()}):
            own = shocked.where((F.col("scenario_id") == name) & (F.col("grouping_id") == grouping))
            made = forecast(own, {k: m for k, m in models.items() if m["grouping_id"] == grouping})
            rows = made if rows is None else rows.unionByName(made)
        out[name] = evaluation.evaluate(rows, family, pairs)
        if name != "primary":
            out[name]["differences"] = scenario.scenario_differences(out[name]["scores"], out["primary"]["scores"], list(evaluation.PRIMARY_SCORES))
    return out


def copula_forecaster(years: int = 3, least: int = 700, draws: int = 100_000) -> Callable[[DataFrame, dict], DataFrame]:
    """What ``scenario_rerun`` forecasts with: the chain of margins and copulas, weights by group size."""

    def weighted(size: str) -> Column:
        return F.col(size) / F.expr(f"sum({size}) over (partition by date)")

    def forecast(groups: DataFrame, models: dict) -> DataFrame:
        rows = groups.select("date", "group_id", "log_return", weighted("group_size").alias("portfolio_weight"))
        return chain.forecast_chain(rows, models, years, least, draws)["forecasts"]

    return forecast
