"""Rolling historical forecasts, their daily scores, and summaries with ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import exception, fz0, pinball

LEVELS = (0.95, 0.975, 0.99)
ES_LEVEL = 0.975


def level_name(level: float) -> str:
    return f"{level:.3f}"[2:].rstrip("0")


def empirical_var_es(ascending: list[float], levels: tuple[float, ...], es_level: float) -> list[float]:
    """Of n losses in order: the ceil(n * level)-th of each level, then the mean of the worst n * (1 - es_level) losses, the
    boundary one in part."""
    n = len(ascending)
    k = math.ceil(n * es_level)
    tail = 0.0
    for x in ascending[k:]:
        tail += x
    return [ascending[math.ceil(n * c) - 1] for c in levels] + [(tail + (k - n * es_level) * ascending[k - 1]) / (n * (1 - es_level))]


def rolling_forecasts(losses: DataFrame, years: int = 3, least: int = 700, levels: tuple[float, ...] = LEVELS, es_level: float = ES_LEVEL) -> DataFrame:
    """losses (model_id, date, loss) -> value at risk and expected shortfall for each date from the losses of the ``years``
    calendar years before it, the date itself left out; dates with fewer than ``least`` losses have no forecast, and a
    model has one loss a date.

    Losses are ranked once over all of a model's dates, and ranks are cut into buckets of about the root of their number. A bucket's counts
    up to each date, at both ends of a window, say how many of the window's losses it has, and their sums over buckets in which one an
    order statistic lies; only the losses of that bucket and those above it are looked at."""
    by_date, by_loss, own = Window.partitionBy("model_id").orderBy("date"), Window.partitionBy("model_id").orderBy("loss", "date"), Window.partitionBy("model_id")
    known = losses.where("loss is not null").select("model_id", F.to_date("date").alias("date"), F.col("loss").cast("double").alias("loss"))
    framed = known.select("*", F.expr(f"count(*) OVER (PARTITION BY model_id ORDER BY date RANGE BETWEEN INTERVAL '{years}' YEAR PRECEDING AND CURRENT ROW)").alias("within"), F.count("*").over(own).alias("size"))
    placed = framed.select("model_id", "date", "loss", (F.col("within") - 1).cast("int").alias("observations"), F.ceil(F.sqrt("size")).cast("int").alias("width"), "size", F.row_number().over(by_date).alias("at"), (F.row_number().over(by_loss) - 1).alias("rank"))
    days = placed.withColumns({"bucket": F.floor(F.col("rank") / F.col("width")).cast("int"), "start": F.col("at") - 1 - F.col("observations")})

    # how many losses of each bucket there are up to each date
    every = days.withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / F.col("width")).cast("int") - 1)))
    hit = (F.col("bucket") == F.col("b")).cast("int")
    upto = every.withColumn("upto", F.sum(hit).over(Window.partitionBy("model_id", "b").orderBy("at")).cast("int")).withColumn("before", F.col("upto") - hit)
    ends = upto.where(F.col("observations") >= least).select("model_id", "at", "date", "loss", "start", "observations", "b", "before")
    starts = upto.select("model_id", "b", F.col("at").alias("start"), F.col("upto").alias("gone"))
    counts = ends.join(starts, ["model_id", "b", "start"], "left").withColumn("inside", F.col("before") - F.coalesce("gone", F.lit(0)))

    # the bucket of the lowest order statistic, and how many losses lie below it
    place = lambda level: F.ceil(F.col("observations") * F.lit(level))
    lowest = place(min(*levels, es_level))
    through = counts.withColumn("through", F.sum("inside").over(Window.partitionBy("model_id", "at").orderBy("b")))
    upper = through.where((F.col("through") >= lowest) & (F.col("inside") > 0)).withColumn("below", F.min(F.col("through") - F.col("inside")).over(Window.partitionBy("model_id", "at")))
    members = days.select("model_id", F.col("bucket").alias("b"), "rank", F.col("at").alias("of"), F.col("loss").alias("x"))
    met = upper.select("model_id", "at", "date", "loss", "start", "observations", "b", "below").join(members, ["model_id", "b"]).where("of > start AND of < at")
    ranked = met.withColumn("k", F.col("below") + F.row_number().over(Window.partitionBy("model_id", "at").orderBy("rank")))
    at_level = lambda level: F.max(F.when(F.col("k") == place(level), F.col("x")))
    share, edge = F.col("observations") * F.lit(es_level), place(es_level)
    shortfall = (F.sum(F.when(F.col("k") > edge, F.col("x")).otherwise(0.0)) + F.max(F.when(F.col("k") == edge, (F.col("k") - share) * F.col("x")))) / F.max(F.col("observations") * F.lit(1 - es_level))
    return ranked.groupBy("model_id", "date", "observations", F.col("loss").alias("realised_loss")).agg(
        *[at_level(c).alias(f"var_{level_name(c)}") for c in levels], shortfall.alias(f"es_{level_name(es_level)}")
    ).select("model_id", "date", "observations", *[f"var_{level_name(c)}" for c in levels], f"es_{level_name(es_level)}", "realised_loss")


def daily_scores(forecasts: DataFrame) -> DataFrame:
    loss = F.col("realised_loss")
    return forecasts.select(
        "*",
        pinball(loss, F.col("var_95"), 0.95).alias("quantile_loss_95"),
        pinball(loss, F.col("var_99"), 0.99).alias("quantile_loss_99"),
        fz0(loss, F.col("var_975"), F.col("es_975")).alias("fz0_975"),
        *[exception(loss, F.col(f"var_{x}")).alias(f"exception_{x}") for x in ("95", "975", "99")],
    )


def average_rank(value: Column, *by: str) -> Column:
    """Rank of a value with ties averaged."""
    order = Window.partitionBy(*by).orderBy(value)
    same = Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count("*").over(same) - 1) / 2.0


def model_summaries(scores: DataFrame, *by: str) -> DataFrame:
    """Mean losses and exceptions of each model, its average rank over the three losses, and the rank of that."""
    names = ("quantile_loss_95", "quantile_loss_99", "fz0_975")
    means = scores.groupBy(*by, "model_id").agg(
        F.count("*").alias("days"),
        *[F.avg(x).alias(f"mean_{x}") for x in names],
        *[F.sum(F.col(f"exception_{x}").cast("long")).alias(f"exceptions_{x}") for x in ("95", "975", "99")],
    )
    ranked = means.withColumn("average_rank", sum((average_rank(F.round(f"mean_{x}", 12), *by) for x in names), F.lit(0.0)) / len(names))
    return ranked.withColumn("overall_rank", average_rank(F.col("average_rank"), *by))
