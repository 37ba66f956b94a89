"""Queries over the driver's tables, one or more for each operator, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dependence as dep
from ..operators import inference as inf
from ..operators import panel as pan
from ..operators import portfolio as por
from ..operators import quality, risk, scenario
from ..sources import views as v
from . import assemblies, evaluations, modelling, records, storage, yearly
from .oracles import SQL


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({x: F.round(x, digits) for x in names})


def _off_ties(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Rounded after a shift that no mean of prices makes: exact ties would fall either way by the order of summation."""
    return df.withColumns({x: F.round(F.col(x) + 1.3e-8, digits) for x in names})


def region_prices(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_off_ties(v.region_prices(s, d), 6, "close"), 9, "high", "low").select("security", "date", "ticker", "close", "high", "low", "volume")


def segment_interval_join(s, d):
    rows = pan.map_segments(v.region_prices(s, d).drop("security"), v.region_segments(s, d), check=False)
    return rows.select("security", "date", "ticker", F.round(F.col("close") + 1.3e-8, 6).alias("close"))


def split_factors(s, d):
    return _rounded(pan.split_factors(v.region_splits(s, d)), 6, "split_factor")


def cash_dividends(s, d):
    return _rounded(pan.cash_dividends(v.region_dividends(s, d)), 6, "cash_dividend")


def _total(s, d):
    return pan.total_returns(v.region_prices(s, d), pan.split_factors(v.region_splits(s, d)), pan.cash_dividends(v.region_dividends(s, d)))


def total_returns(s, d):
    rows = _off_ties(_rounded(_total(s, d), 6, "total_return", "log_total_return"), 6, "consideration")
    return rows.select("security", "date", "consideration", "total_return", "log_total_return", "quality_flag")


def event_dispositions(s, d):
    raw = v.region_splits(s, d).where(F.year("date") != 1996)
    named = raw.withColumn("ticker", F.concat("security", F.when(F.year("date") < 1998, "_OLD").otherwise("_NEW"))).drop("security")
    mapped = pan.map_segments(named, v.region_segments(s, d), check=False).where("security <> 'ASIA'")
    return pan.event_dispositions(raw, mapped, v.region_prices(s, d))


def superseded_events(s, d):
    splits = v.region_splits(s, d)
    return pan.not_superseded(splits, splits.where("event_id % 3 = 0")).select("event_id", "security", "date", "factor")


def numeric_integrity(s, d):
    """Prices spoilt by date: no opening price on the 7th of a month, a negative volume on the 8th."""
    day = F.dayofmonth("date")
    rows = v.region_prices(s, d).withColumn("open", F.when(day != 7, F.col("close")))
    return quality.numeric_integrity(rows.withColumn("volume", F.when(day == 8, -F.col("volume")).otherwise(F.col("volume"))))


def coverage(s, d):
    rows = pan.coverage(_total(s, d), v.region_prices(s, d).select("date").distinct())
    return _rounded(rows, 6, "price_coverage", "return_coverage").drop("sessions")


def early_exits(s, d):
    return pan.early_exits(v.nation_returns(s, d).withColumn("close", F.lit(1.0)), v.nation_exits(s, d), F.to_date(F.lit("2001-08-01")))


def extreme_observations(s, d):
    reviews = v.region_prices(s, d).where("volume > 300").select("security", "date", F.lit("large volume").alias("review"))
    return _rounded(pan.extreme_observations(_total(s, d), reviews), 6, "total_return")


def lifecycle_grid(s, d):
    day = lambda x: F.to_date(F.lit(x))
    third = F.col("r_regionkey") == 2
    securities = v.table(s, d, "region").select(
        F.col("r_name").alias("security"),
        F.date_add(day("1995-01-10"), F.col("r_regionkey")).alias("listing"),
        F.lit(None).cast("date").alias("terminal"),
        F.when(third, day("2000-01-01")).alias("cash_start"),
        F.when(third, day("2001-01-01")).alias("remove"),
    )
    prices = v.region_prices(s, d)
    halts = prices.where("day(date) = 13").select("date").distinct().crossJoin(securities.select("security"))
    grid = pan.lifecycle_grid(prices.where("day(date) <> 13"), prices.select("date").distinct(), securities, halts)
    return _off_ties(grid.drop("ticker"), 6, "close")


def _schedule(s, d):
    return pan.active_schedule(v.nation_returns(s, d).select("security").distinct(), v.nation_calendar(s, d), v.nation_exits(s, d))


def active_schedule(s, d):
    return _schedule(s, d)


def terminal_cash_carry(s, d):
    panel, exits = v.nation_returns(s, d), v.nation_exits(s, d)
    known = panel.join(exits.select("security", F.lit(True).alias("leaves")), "security", "left").where("leaves is null or date < date'1998-07-01'")
    grid = panel.select("security").distinct().crossJoin(v.nation_calendar(s, d))
    return _rounded(pan.carry_cash(grid.join(known.drop("leaves"), ["security", "date"], "left"), exits), 8, "simple_return")


def share_class_composite(s, d):
    return _rounded(pan.composite(v.region_returns(s, d), "ASIA", "EUROPE", "EURASIA"), 6, "simple_return")


def group_returns(s, d):
    return _rounded(por.group_returns(v.nation_returns(s, d), v.nation_labels(s, d)), 8, "simple_return", "portfolio_weight", "log_return")


def portfolio_reconstruction(s, d):
    return _rounded(por.reconstruction(v.nation_returns(s, d), v.nation_labels(s, d)), 9, "max_error")


def equal_weight_portfolio(s, d):
    return _rounded(por.equal_weight(v.nation_returns(s, d), _schedule(s, d)), 8, "simple_return")


def evaluation_year_backcast(s, d):
    return _rounded(por.backcast(v.nation_returns(s, d), _schedule(s, d)), 8, "simple_return")


def buy_and_hold(s, d):
    weights = por.equal_group_weights(v.nation_labels(s, d)).select("security", "initial_weight")
    held = por.buy_and_hold(v.nation_returns(s, d), weights)
    return _rounded(held, 8, "weight", "simple_return").select("security", "date", "weight", "simple_return")


def balanced_groups(s, d):
    return _rounded(por.balanced_groups(v.nation_returns(s, d), v.nation_labels(s, d)), 8, "group_weight", "group_return").drop("period")


def _spearman(s, d):
    return dep.pairwise_spearman(v.nation_returns(s, d))


def pairwise_spearman(s, d):
    return _rounded(dep.correlation_distance(_spearman(s, d)), 6, "spearman", "distance")


def dependence_gap(s, d):
    return _rounded(dep.dependence_gap(_spearman(s, d), v.nation_labels(s, d)), 6, "within_mean", "between_mean", "balanced_gap", "gap")


def adjusted_rand_index(s, d):
    rows = v.table(s, d, "customer").join(v.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return _rounded(dep.adjusted_rand_index(rows, "c_mktsegment", "n_regionkey"), 6, "ari")


def normalized_mutual_information(s, d):
    return _rounded(dep.normalized_mutual_information(v.table(s, d, "documents"), "lang", "source"), 6, "nmi")


def contingency(s, d):
    return dep.contingency(v.table(s, d, "documents"), "lang", "source")


def _forecasts(s, d):
    return risk.rolling_forecasts(v.region_losses(s, d))


def _scores(s, d):
    return risk.daily_scores(_forecasts(s, d))


def rolling_var_es(s, d):
    return _rounded(_forecasts(s, d), 6, "var_95", "var_975", "var_99", "es_975", "realised_loss")


def daily_scores(s, d):
    rows = _rounded(_rounded(_scores(s, d), 7, "quantile_loss_95", "quantile_loss_99"), 5, "fz0_975")
    return rows.select("model_id", "date", "quantile_loss_95", "quantile_loss_99", "fz0_975", "exception_95", "exception_975", "exception_99")


def risk_model_summary(s, d):
    rows = risk.model_summaries(_scores(s, d))
    return _rounded(_rounded(rows, 8, "mean_quantile_loss_95", "mean_quantile_loss_99"), 6, "mean_fz0_975", "average_rank")


def _series(s, d):
    return inf.exception_series(_scores(s, d))


def unconditional_coverage(s, d):
    return _rounded(inf.unconditional_coverage(_series(s, d)), 6, "lr_uc")


def transitions(s, d):
    return inf.transitions(_series(s, d))


def calibration(s, d):
    return _rounded(inf.calibration(_series(s, d)), 6, "lr_uc", "lr_ind", "p_uc", "p_ind", "p_cc")


def _dm(s, d):
    scores = _scores(s, d)
    names = v.table(s, d, "region").select(F.col("r_name").alias("model_id"))
    pairs = names.join(names.toDF("baseline_id"), F.col("model_id") < F.col("baseline_id"))
    return inf.diebold_mariano(inf.loss_differences(scores, pairs, "fz0_975"))


def diebold_mariano(s, d):
    return _rounded(_rounded(_dm(s, d), 6, "mean_difference"), 5, "dm_statistic")


def diebold_mariano_p_values(s, d):
    rows = inf.holm(inf.with_p_values(_dm(s, d)), "p_value", ["model_id", "baseline_id"])
    return _rounded(_rounded(rows, 6, "mean_difference", "p_value", "p_holm"), 5, "dm_statistic")


def holm_adjustment(s, d):
    tests = inf.with_p_values(_dm(s, d)).select("model_id", "baseline_id", F.col("p_value").alias("p"))
    rows = inf.benjamini_hochberg(inf.holm(tests, "p", ["model_id", "baseline_id"]), "p", ["model_id", "baseline_id"])
    return _rounded(rows, 6, "p", "p_holm", "p_bh")


def calendar_rebalance(s, d):
    return pan.rebalance_dates(v.nation_calendar(s, d))


def reshape_wide(s, d):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    rows = por.group_returns(v.nation_returns(s, d), v.nation_labels(s, d))
    return _rounded(rows.groupBy("date").pivot("group_id", names).agg(F.first("simple_return")), 8, *names)


def key_differences(s, d):
    large = v.table(s, d, "orders").where("o_totalprice > 250000")
    rows = v.table(s, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"))


def extreme_days_top(s, d):
    from pyspark.sql import Window

    order = Window.partitionBy("security").orderBy(F.desc("simple_return"), "date")
    rows = v.region_returns(s, d).where("simple_return is not null").withColumn("k", F.row_number().over(order))
    return _rounded(rows.where("k <= 5").drop("k"), 6, "simple_return")


def stock_shock(s, d):
    return _rounded(scenario.shock_one(v.nation_returns(s, d), "NATION_1", "1996-03-01", 0.5), 8, "simple_return")


def group_shock(s, d):
    panel, labels = v.nation_returns(s, d), v.nation_labels(s, d)
    rows = scenario.shock_groups(por.group_returns(panel, labels), panel, labels, "NATION_1", "1996-03-01", 0.5)
    return _rounded(rows, 8, "simple_return").select("date", "group_id", "simple_return")


def best_model(s, d):
    return scenario.best_model(risk.model_summaries(_scores(s, d))).select("model_id", F.round("average_rank", 6).alias("average_rank"))


def calibration_expected(s, d):
    rows = scenario.calibration_table(inf.unconditional_coverage(_series(s, d)))
    return _rounded(rows, 4, "expected_exceptions").select("model_id", "level", "days", "exceptions", "expected_exceptions")


_QUERIES = (
    region_prices, segment_interval_join, split_factors, cash_dividends, total_returns, event_dispositions, superseded_events, numeric_integrity, coverage, early_exits,
    extreme_observations, lifecycle_grid, active_schedule, terminal_cash_carry, share_class_composite, group_returns, portfolio_reconstruction, equal_weight_portfolio,
    evaluation_year_backcast, buy_and_hold, balanced_groups, pairwise_spearman, dependence_gap, adjusted_rand_index, normalized_mutual_information, contingency, rolling_var_es,
    daily_scores, risk_model_summary, unconditional_coverage, transitions, calibration, diebold_mariano, diebold_mariano_p_values, holm_adjustment, calendar_rebalance, reshape_wide,
    key_differences, extreme_days_top, stock_shock, group_shock, best_model, calibration_expected,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | assemblies.queries() | evaluations.queries() | yearly.queries() | modelling.queries() | records.queries() | storage.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | assemblies.oracle_sql() | evaluations.oracle_sql() | yearly.oracle_sql() | modelling.oracle_sql() | records.oracle_sql() | storage.oracle_sql()
