"""One-cell what-if shocks, and the tables and decisions that reports are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import require_none


def shock_one(panel: DataFrame, security: str, date, simple_return: float) -> DataFrame:
    """The panel with one return replaced; it is an error if the cell isn't there exactly once."""
    cell = (F.col("security") == security) & (F.col("date") == F.lit(date))
    hits = panel.where(cell).agg(F.count("*").alias("n"))
    require_none(hits.where("n <> 1"), f"{security} on {date} is not one cell")
    return panel.withColumn("simple_return", F.when(cell, F.lit(simple_return)).otherwise(F.col("simple_return")))


def shock_groups(groups: DataFrame, panel: DataFrame, labels: DataFrame, security: str, date, simple_return: float) -> DataFrame:
    """Group returns after the same shock: the security's group moves by the change over its size on that date."""
    old = panel.where((F.col("security") == security) & (F.col("date") == F.lit(date))).join(labels, "security")
    change = old.select("date", "group_id", (F.lit(simple_return) - F.col("simple_return")).alias("change"))
    rows = groups.join(change, ["date", "group_id"], "left")
    moved = F.col("simple_return") + F.coalesce(F.col("change") / F.col("group_size"), F.lit(0.0))
    return rows.withColumn("simple_return", moved).withColumn("log_return", F.log1p("simple_return")).drop("change")


def event_return(previous_close: float, cash: float, value: float) -> float:
    """The return of a day on which a security turns into cash and a right of some value."""
    if not previous_close > 0:
        raise ValueError("the close before the event must be positive")
    return (cash + value) / previous_close - 1


def affected_groups(labels: DataFrame, security: str, year: int) -> DataFrame:
    """(grouping_id, group_id): the security's one group in each grouping of a year; a grouping without it, or with several, fails."""
    own = labels.where((F.col("security") == security) & (F.col("year") == year)).groupBy("grouping_id").agg(F.count("*").alias("n"), F.first("group_id").alias("group_id"))
    every = labels.where(F.col("year") == year).select("grouping_id").distinct()
    require_none(every.join(own, "grouping_id", "left").where("n is null or n <> 1"), f"{security} is not in one group of each grouping")
    return own.select("grouping_id", "group_id")


def scenario_groups(groups: DataFrame, labels: DataFrame, panel: DataFrame, security: str, date, values: dict[str, float]) -> DataFrame:
    """(scenario_id, grouping_id, date, group_id, simple_return, log_return, group_size): every grouping's group returns under each scenario.
    In each, the affected group moves by the change of the stock's return over its size on that one date. values: scenario -> return."""
    spark = groups.sparkSession
    day = F.to_date(F.lit(date))
    old = panel.where((F.col("security") == security) & (F.col("date") == day)).select(F.col("simple_return").alias("old"))
    require_none(old.agg(F.count("*").alias("n")).where("n <> 1"), f"{security} on {date} is not one cell")
    hit = affected_groups(labels, security, int(str(date)[:4]))
    scenarios = spark.createDataFrame(list(values.items()), "scenario_id string, new double")
    moved = hit.join(scenarios).join(old).select("scenario_id", "grouping_id", "group_id", day.alias("date"), (F.col("new") - F.col("old")).alias("change"))
    rows = groups.join(F.broadcast(scenarios.select("scenario_id"))).join(moved, ["scenario_id", "grouping_id", "group_id", "date"], "left")
    simple = F.col("simple_return") + F.coalesce(F.col("change") / F.col("group_size"), F.lit(0.0))
    return rows.withColumn("simple_return", simple).select("scenario_id", "grouping_id", "date", "group_id", "simple_return", F.log1p("simple_return").alias("log_return"), "group_size")


def portfolio_identity(shocked: DataFrame, primary: DataFrame, date, change: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """By scenario and grouping: the largest difference between the portfolio of shocked groups and the primary portfolio moved by the
    stock's change over the number of securities, and the largest difference on other dates, which must be none. shocked, primary
    (grouping_id, date, simple_return, group_size; shocked also scenario_id); change (scenario_id, change)."""
    mean = lambda df, *keys: df.groupBy(*keys, "grouping_id", "date").agg((F.sum(F.col("simple_return") * F.col("group_size")) / F.sum("group_size")).alias("r"), F.sum("group_size").alias("n"))
    both = mean(shocked, "scenario_id").join(mean(primary).withColumnsRenamed({"r": "before", "n": "size"}), ["grouping_id", "date"]).join(change, "scenario_id")
    day = F.col("date") == F.to_date(F.lit(date))
    off = F.abs(F.col("r") - F.col("before") - F.when(day, F.col("change") / F.col("n")).otherwise(0.0))
    out = both.groupBy("scenario_id", "grouping_id").agg(F.max(F.when(day, off)).alias("event_error"), F.max(F.when(~day, off)).alias("other_error"))
    return out.withColumn("status", F.when((F.col("event_error") <= tolerance) & (F.coalesce("other_error", F.lit(0.0)) <= tolerance), "pass").otherwise("fail"))


def scenario_differences(scenario: DataFrame, primary: DataFrame, columns: list[str]) -> DataFrame:
    """By model: mean and largest absolute differences of scores; dates that only one side has are an error."""
    a = scenario.select("date", "model_id", *[F.col(c).alias(f"s_{c}") for c in columns], F.lit(True).alias("in_s"))
    b = primary.select("date", "model_id", *columns, F.lit(True).alias("in_p"))
    both = a.join(b, ["date", "model_id"], "full_outer")
    require_none(both.where("in_s is null or in_p is null").select("date", "model_id"), "unmatched scores")
    parts = [x for c in columns for x in (F.avg(F.col(f"s_{c}") - F.col(c)).alias(f"mean_{c}"), F.max(F.abs(F.col(f"s_{c}") - F.col(c))).alias(f"most_{c}"))]
    return both.groupBy("model_id").agg(F.count("*").alias("days"), *parts)


def performance_table(summaries: DataFrame, names: dict[str, str]) -> DataFrame:
    """Summaries in the order of ``names`` (model_id -> label), with the order as position."""
    order = summaries.sparkSession.createDataFrame([(i, k, v) for i, (k, v) in enumerate(names.items())], "position int, model_id string, label string")
    return order.join(summaries, "model_id").orderBy("position")


def calibration_table(calibration: DataFrame) -> DataFrame:
    return calibration.withColumn("expected_exceptions", F.col("days") * (1 - F.col("level")))


def best_model(summaries: DataFrame, rank: str = "average_rank") -> DataFrame:
    return summaries.withColumn("k", F.row_number().over(Window.orderBy(rank, "model_id"))).where("k = 1").drop("k")


def support(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """full where all adjusted tests favour the model, partial where one does and none favours the baseline, else none."""
    better = (F.col("p_holm") <= alpha) & (F.col("mean_difference") < 0)
    worse = (F.col("p_holm") <= alpha) & (F.col("mean_difference") > 0)
    counted = tests.agg(F.count("*").alias("tests"), F.count_if(better).alias("better"), F.count_if(worse).alias("worse"))
    return counted.withColumn("support", F.when(F.col("better") == F.col("tests"), "full").when((F.col("better") > 0) & (F.col("worse") == 0), "partial").otherwise("none"))


def log_score_comparison(scores: DataFrame, left: str, right: str) -> DataFrame:
    """Mean difference of copula log scores of two models on the dates that both have."""
    a, b = (scores.where(F.col("model_id") == m).select("date", F.col("copula_log_score").alias(n)) for m, n in ((left, "a"), (right, "b")))
    return a.join(b, "date").agg(F.count("*").alias("days"), F.avg(F.col("a") - F.col("b")).alias("mean_difference"))


def combined(sources: list[DataFrame], tolerance: float = 1e-12) -> DataFrame:
    """Forecasts of all models: unique by model and date, the same dates for each, and one realised loss a date."""
    rows = sources[0]
    for other in sources[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    require_none(rows.groupBy("model_id", "date").count().where("count > 1"), "repeated forecasts")
    models = rows.select("model_id").distinct().agg(F.count("*").alias("models"))
    by_date = rows.groupBy("date").agg(F.countDistinct("model_id").alias("n"), (F.max("realised_loss") - F.min("realised_loss")).alias("spread"))
    require_none(by_date.join(models).where((F.col("n") != F.col("models")) | (F.col("spread") > tolerance)), "forecasts do not match")
    return rows
