"""Backtests of forecasts: coverage, independence, equal accuracy, and adjustments for many tests.

Statistics are aggregates and window functions; only their p-values need a vectorised Python function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import bernoulli_log_likelihood
from ..functions.special import chi2_1_survival, two_sided_normal


def exception_series(scores: DataFrame, levels: tuple[str, ...] = ("95", "99")) -> DataFrame:
    """(model_id, level, date, hit) from the daily scores."""
    pairs = F.explode(F.array(*[F.struct(F.lit(float(f"0.{x}")).alias("level"), F.col(f"exception_{x}").cast("int").alias("hit")) for x in levels]))
    return scores.select("model_id", "date", pairs.alias("p")).select("model_id", "p.level", "date", "p.hit")


def _likelihood_ratio(restricted: Column, free: Column) -> Column:
    return F.greatest(F.lit(0.0), -2 * (restricted - free))


def unconditional_coverage(series: DataFrame, *by: str) -> DataFrame:
    """Kupiec's test: exceptions against the level's share."""
    keys = by or ("model_id", "level")
    counts = series.groupBy(*keys).agg(F.count("*").alias("days"), F.sum("hit").alias("exceptions"))
    share = F.lit(1.0) - F.col("level")
    free = bernoulli_log_likelihood(F.col("exceptions"), F.col("days"), F.col("exceptions") / F.col("days"))
    return counts.withColumn("lr_uc", _likelihood_ratio(bernoulli_log_likelihood(F.col("exceptions"), F.col("days"), share), free))


def transitions(series: DataFrame, *by: str) -> DataFrame:
    """Counts of the four steps from one date's hit to the next date's."""
    keys = by or ("model_id", "level")
    rows = series.withColumn("before", F.lag("hit").over(Window.partitionBy(*keys).orderBy("date"))).where("before is not null")
    return rows.groupBy(*keys).agg(*[F.count_if((F.col("before") == i) & (F.col("hit") == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])


def independence(series: DataFrame, *by: str) -> DataFrame:
    """Christoffersen's first-order test; a state that never occurs has probability 0."""
    counts = transitions(series, *by)
    n00, n01, n10, n11 = (F.col(x) for x in ("n00", "n01", "n10", "n11"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    together = bernoulli_log_likelihood(n01 + n11, n00 + n01 + n10 + n11, ratio(n01 + n11, n00 + n01 + n10 + n11))
    apart = bernoulli_log_likelihood(n01, n00 + n01, ratio(n01, n00 + n01)) + bernoulli_log_likelihood(n11, n10 + n11, ratio(n11, n10 + n11))
    return counts.withColumn("lr_ind", _likelihood_ratio(together, apart))


def calibration(series: DataFrame, *by: str) -> DataFrame:
    """Both tests and conditional coverage, with p-values."""
    keys = list(by or ("model_id", "level"))
    rows = unconditional_coverage(series, *keys).join(independence(series, *keys), keys)
    return rows.withColumns(
        {"p_uc": chi2_1_survival(F.col("lr_uc")), "p_ind": chi2_1_survival(F.col("lr_ind")), "p_cc": F.exp(-(F.col("lr_uc") + F.col("lr_ind")) / 2)}
    )


def loss_differences(scores: DataFrame, pairs: DataFrame, loss: str, *by: str) -> DataFrame:
    """(model_id, baseline_id, by, date, d): each pair's loss difference on the dates that both have. pairs: (model_id,
    baseline_id). The scores are read once: each goes to the pairs it takes part in, with its sign."""
    one = pairs.select(F.col("model_id").alias("scored"), "model_id", "baseline_id", F.lit(1.0).alias("sign"))
    other = pairs.select(F.col("baseline_id").alias("scored"), "model_id", "baseline_id", F.lit(-1.0).alias("sign"))
    parts = scores.select(F.col("model_id").alias("scored"), *by, "date", F.col(loss).alias("loss")).join(one.unionByName(other), "scored")
    both = parts.groupBy("model_id", "baseline_id", *by, "date").agg(F.sum(F.col("sign") * F.col("loss")).alias("d"), F.countDistinct("sign").alias("sides"))
    return both.where("sides = 2").drop("sides")


def diebold_mariano(differences: DataFrame, lags: int = 7, *by: str) -> DataFrame:
    """Mean difference over its Newey-West error with Bartlett weights; null where the long-run variance is not positive."""
    keys = list(by or ("model_id", "baseline_id"))
    order = Window.partitionBy(*keys).orderBy("date")
    rows = differences.withColumn("c", F.col("d") - F.avg("d").over(Window.partitionBy(*keys)))
    sums = [F.sum(F.col("c") * F.col("c")).alias("g0")] + [F.coalesce(F.sum(F.col("c") * F.col(f"c{k}")), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)]
    rows = rows.withColumns({f"c{k}": F.lag("c", k).over(order) for k in range(1, lags + 1)})
    out = rows.groupBy(*keys).agg(F.count("*").alias("days"), F.avg("d").alias("mean_difference"), *sums)
    variance = F.col("g0") / F.col("days")
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.col(f"g{k}") / F.col("days")
    statistic = F.when(variance > 0, F.col("mean_difference") / F.sqrt(variance / F.col("days")))
    return out.withColumn("dm_statistic", statistic).select(*keys, "days", "mean_difference", "dm_statistic")


def with_p_values(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", two_sided_normal(F.col("dm_statistic")))


def holm(tests: DataFrame, p: str, order: list[str], *family: str) -> DataFrame:
    """Step-down adjusted p-values within a family; ``order`` settles ties."""
    by = Window.partitionBy(*family)
    step = Window.partitionBy(*family).orderBy(p, *order)
    scaled = F.least(F.lit(1.0), (F.count("*").over(by) - F.row_number().over(step) + 1) * F.col(p))
    return tests.withColumn("_scaled", scaled).withColumn("p_holm", F.max("_scaled").over(step.rowsBetween(Window.unboundedPreceding, 0))).drop("_scaled")


def benjamini_hochberg(tests: DataFrame, p: str, order: list[str], *family: str) -> DataFrame:
    by = Window.partitionBy(*family)
    step = Window.partitionBy(*family).orderBy(p, *order)
    scaled = F.col(p) * F.count("*").over(by) / F.row_number().over(step)
    up = step.rowsBetween(0, Window.unboundedFollowing)
    return tests.withColumn("_scaled", scaled).withColumn("p_bh", F.least(F.lit(1.0), F.min("_scaled").over(up))).drop("_scaled")
