"""Queries of the operators whose kernels are NumPy inside grouped functions; SQL cannot express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bootstrap, chain, cluster, copula, margins
from ..operators import dependence as dep
from ..sources import views as v
from . import protocol
from .oracles import RETURNS


def _pairs(s, d):
    pairs = dep.pairwise_spearman(v.nation_returns(s, d)).na.fill(0.0, ["spearman"])
    return pairs.withColumn("year", F.lit(2000))


def hierarchical_clusters(s, d):
    return cluster.cluster_by(_pairs(s, d), "year", "hierarchical", 5)


def spectral_clusters(s, d):
    return cluster.cluster_by(_pairs(s, d), "year", "spectral", 5)


def profile_clusters(s, d):
    return cluster.cluster_by(_pairs(s, d), "year", "pca", 5)


def _series(s, d):
    rows = v.region_returns(s, d).where("simple_return > -1")
    return rows.select(F.col("security").alias("group_id"), "date", (F.log1p("simple_return") / 100).alias("log_return"))


def margin_refits(s, d):
    return margins.monthly(_series(s, d))


def margin_daily(s, d):
    return margins.monthly(_series(s, d), out="daily")


def _group_returns(s, d):
    """The regions' series on the days that all five have, with equal weights."""
    rows = _series(s, d)
    whole = rows.groupBy("date").count().where("count = 5").select("date")
    return rows.join(whole, "date").withColumn("portfolio_weight", F.lit(0.2))


def gaussian_copula_forecasts(s, d):
    """Equal weights over the five regions; each month's copula is fitted on the days that its margins were fitted on."""
    return chain.forecast_chain(_group_returns(s, d), {"M1": {"grouping_id": "gics"}})["forecasts"]


def vine_copula_forecasts(s, d):
    """The same margins under a vine of three trees, with a tenth of the draws."""
    return chain.forecast_chain(_group_returns(s, d), {"M2": {"grouping_id": "gics", "truncation": 3}}, draws=10_000)["forecasts"]


def refit_tasks(s, d):
    return chain.refit_tasks(_group_returns(s, d))


def group_panel_problems(s, d):
    """Group returns spoilt by date: every fifth of a month one weight is off, every ninth one return is missing."""
    rows = _group_returns(s, d)
    off = (F.col("group_id") == "ASIA") & (F.dayofmonth("date") == 5)
    gone = (F.col("group_id") == "AFRICA") & (F.dayofmonth("date") == 9)
    rows = rows.withColumns({"portfolio_weight": F.when(off, F.lit(0.3)).otherwise(F.col("portfolio_weight")), "log_return": F.when(gone, F.lit(None)).otherwise(F.col("log_return"))})
    return chain.group_panel_problems(rows)


def vine_pairs(s, d):
    """Midranks of a year's region returns as transforms, one block a year."""
    rows = v.region_returns(s, d).where("simple_return is not null").withColumn("refit_date", F.to_date(F.trunc("date", "year")))
    block = Window.partitionBy("refit_date", "group_id")
    rank = F.rank().over(block.orderBy("simple_return")) + (F.count("*").over(Window.partitionBy("refit_date", "group_id", "simple_return")) - 1) / 2.0
    rows = rows.withColumn("group_id", F.col("security"))
    return copula.vine_refits(rows.withColumn("pit", (rank - 0.5) / F.count("*").over(block)).select("refit_date", "date", "group_id", "pit"))


def gap_bootstrap(s, d):
    """The gap of the nations' regions less that of three groups of their keys, over years of monthly returns of the nations that have all
    of a year's months. Blocks are of 3 rows, not the protocol's 20 days: a year has at most 12 monthly rows, which one block of 20
    would only rotate."""
    rows = v.nation_returns(s, d).withColumn("year", F.year("date"))
    months = rows.groupBy("year").agg(F.countDistinct("date").alias("months")).where("months >= 6")
    whole = rows.groupBy("year", "security").agg(F.count("simple_return").alias("n")).join(months, "year").where("n = months")
    several = whole.groupBy("year").count().where("count >= 4").select("year")
    kept = whole.join(several, "year").select("year", "security")
    keys = v.table(s, d, "nation").select(F.col("n_name").alias("security"), (F.col("n_nationkey") % 3).cast("string").alias("given"))
    labels = kept.join(v.nation_labels(s, d).withColumnRenamed("group_id", "cluster"), "security").join(keys, "security")
    return bootstrap.paired_gap_bootstrap(rows.join(kept, ["year", "security"]), labels, protocol.FROZEN["inference"]["replications"], 3)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (hierarchical_clusters, spectral_clusters, profile_clusters, margin_refits, margin_daily, gaussian_copula_forecasts, vine_copula_forecasts, refit_tasks, group_panel_problems, vine_pairs, gap_bootstrap)
    }


_SERIES = RETURNS + """,
series AS (SELECT security AS group_id, date, ln(1 + r) / 100 AS log_return FROM returns WHERE r IS NOT NULL AND r > -1),
panel AS (SELECT * FROM series WHERE date IN (SELECT date FROM series GROUP BY date HAVING count(*) = 5))"""


def oracle_sql() -> dict[str, str]:
    return {
        "refit_tasks": f"""WITH {_SERIES}, m AS (SELECT group_id, date_trunc('month', date) AS month, min(date) AS refit_date, CAST(count(*) AS INTEGER) AS evaluation_days FROM panel GROUP BY 1, 2)
            SELECT m.group_id, m.refit_date, m.evaluation_days, min(p.date) AS training_start, max(p.date) AS training_end, CAST(count(*) AS INTEGER) AS observations
            FROM m JOIN panel p ON p.group_id = m.group_id AND p.date >= m.refit_date - INTERVAL 3 YEAR AND p.date < m.refit_date GROUP BY 1, 2, 3 HAVING count(*) >= 700""",
        "group_panel_problems": f"""WITH {_SERIES} SELECT 'nonfinite_return' AS code, date || '|' || group_id AS key FROM panel WHERE group_id = 'AFRICA' AND day(date) = 9
            UNION ALL SELECT DISTINCT 'weights_do_not_sum_to_one', CAST(date AS VARCHAR) FROM panel WHERE day(date) = 5""",
    }
