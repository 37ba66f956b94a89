"""Portfolio arithmetic on long return panels (security, date, simple_return)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_returns(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """(date, group_id): equal-weight mean, size, weight = size over the date's sum of sizes, and log return."""
    rows = panel.join(labels.select("security", "group_id"), "security")
    means = rows.groupBy("date", "group_id").agg(F.avg("simple_return").alias("simple_return"), F.count("simple_return").alias("group_size"))
    weight = F.col("group_size") / F.sum("group_size").over(Window.partitionBy("date"))
    return means.withColumn("portfolio_weight", weight).withColumn("log_return", F.log1p("simple_return"))


def equal_weight(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Daily mean over the year's active set, on dates on which all of it has a return."""
    size = schedule.groupBy("year").agg(F.count("*").alias("active_count"))
    rows = panel.withColumn("year", F.year("date")).join(schedule.select("year", "security"), ["year", "security"])
    days = rows.groupBy("year", "date").agg(F.avg("simple_return").alias("simple_return"), F.count("simple_return").alias("present"))
    return days.join(size, "year").where(F.col("present") == F.col("active_count")).select("date", "year", "simple_return", "active_count")


def backcast(panel: DataFrame, schedule: DataFrame, years: int = 3) -> DataFrame:
    """For each evaluation year, the mean of that year's active set on the dates of the ``years`` before it and its own."""
    rows = panel.join(schedule.select(F.col("year").alias("evaluation_year"), "security", "rebalance_date"), "security")
    rows = rows.where((F.col("date") >= F.add_months("rebalance_date", -12 * years)) & (F.year("date") <= F.col("evaluation_year")))
    size = schedule.groupBy(F.col("year").alias("evaluation_year")).agg(F.count("*").alias("active_count"))
    days = rows.groupBy("evaluation_year", "date").agg(F.avg("simple_return").alias("simple_return"), F.count("simple_return").alias("present"))
    return days.join(size, "evaluation_year").where(F.col("present") == F.col("active_count")).select("evaluation_year", "date", "simple_return", "active_count")


def reconstruction(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """By year: the largest difference between the mean over securities and the size-weighted mean over groups."""
    rows = panel.join(labels.select("security"), "security").where("simple_return is not null")
    direct = rows.groupBy("date").agg(F.avg("simple_return").alias("direct"))
    groups = group_returns(rows.select("security", "date", "simple_return"), labels)
    weighted = groups.groupBy("date").agg(F.sum(F.col("simple_return") * F.col("portfolio_weight")).alias("weighted"))
    return direct.join(weighted, "date").groupBy(F.year("date").alias("year")).agg(
        F.max(F.abs(F.col("direct") - F.col("weighted"))).alias("max_error"), F.count("*").alias("days")
    )


def buy_and_hold(panel: DataFrame, weights: DataFrame, period=None) -> DataFrame:
    """Drifting weights (security, initial_weight) without rebalancing within a period (the calendar year unless given).

    The recursion w' = w (1 + r) / (1 + R) has the closed form w0 * exp(sum of log1p of the returns before), normalised by
    date, so a running sum by security and one aggregate by date replace it. Gives each security's weight before the day's
    return, and its return."""
    period = F.year("date") if period is None else period
    before = Window.partitionBy("security", "period").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    rows = panel.join(weights, "security").withColumn("period", period)
    grown = rows.withColumn("wealth", F.col("initial_weight") * F.exp(F.coalesce(F.sum(F.log1p("simple_return")).over(before), F.lit(0.0))))
    return grown.withColumn("weight", F.col("wealth") / F.sum("wealth").over(Window.partitionBy("date"))).select(
        "security", "date", "period", "simple_return", "weight"
    )


def portfolio_of(held: DataFrame) -> DataFrame:
    return held.groupBy("date", "period").agg(F.sum(F.col("weight") * F.col("simple_return")).alias("simple_return"), F.sum("weight").alias("weight_sum"))


def equal_group_weights(labels: DataFrame) -> DataFrame:
    """1 / (number of groups * members of the group)."""
    sizes = labels.groupBy("group_id").agg(F.count("*").alias("members"))
    groups = labels.agg(F.countDistinct("group_id").alias("groups"))
    return labels.join(sizes, "group_id").join(groups).select("security", "group_id", (1.0 / (F.col("groups") * F.col("members"))).alias("initial_weight"))


def balanced_groups(panel: DataFrame, labels: DataFrame) -> DataFrame:
    """Equal-group portfolio that drifts within a calendar year: each group's weight before the day and its return."""
    held = buy_and_hold(panel, equal_group_weights(labels).select("security", "initial_weight")).join(labels, "security")
    return held.groupBy("date", "period", "group_id").agg(
        F.sum("weight").alias("group_weight"), (F.sum(F.col("weight") * F.col("simple_return")) / F.sum("weight")).alias("group_return")
    )


def drift_errors(held: DataFrame) -> DataFrame:
    """By period: how far the weights are from following the drift law, and their sums from one."""
    days = portfolio_of(held).select("date", F.col("simple_return").alias("total"), "weight_sum")
    order = Window.partitionBy("security", "period").orderBy("date")
    rows = held.join(days, "date").withColumn("next_weight", F.lead("weight").over(order))
    law = F.abs(F.col("next_weight") - F.col("weight") * (1 + F.col("simple_return")) / (1 + F.col("total")))
    return rows.groupBy("period").agg(F.max(law).alias("law_error"), F.max(F.abs(F.col("weight_sum") - 1)).alias("sum_error"))
