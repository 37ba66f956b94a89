"""The driver's tables in the shapes that the operators take.

Securities are regions (by day, from line items) or nations (by month, from orders); segments, corporate actions, exits and
halts are derived from the same tables by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def region_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(security, date, ticker, open, high, low, close, volume): unit prices of a region's line items by ship date."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("r_name").alias("security"), F.to_date("l_shipdate").alias("date"))
        .agg(F.avg(unit).alias("close"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("l_quantity").cast("long").alias("volume"))
        .withColumn("ticker", F.when(F.year("date") < 1998, F.concat("security", F.lit("_OLD"))).otherwise(F.concat("security", F.lit("_NEW"))))
    )


def region_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(security, date, simple_return) between a region's successive prices."""
    order = Window.partitionBy("security").orderBy("date")
    rows = region_prices(spark, sf_dir).withColumn("simple_return", F.col("close") / F.lag("close").over(order) - 1)
    return rows.select("security", "date", "simple_return")


def region_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, date, loss) of each region's returns, scaled to a hundredth."""
    rows = region_returns(spark, sf_dir).where("simple_return is not null")
    return rows.select(F.col("security").alias("model_id"), "date", (-F.col("simple_return") / 100).alias("loss"))


def nation_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(security, date, simple_return): monthly changes of a nation's mean order price."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    months = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("n_name").alias("security"), F.to_date(F.trunc("o_orderdate", "month")).alias("date"))
        .agg(F.avg("o_totalprice").alias("close"))
    )
    order = Window.partitionBy("security").orderBy("date")
    return months.withColumn("simple_return", (F.col("close") / F.lag("close").over(order) - 1) / 10).where("simple_return is not null").select("security", "date", "simple_return")


def nation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("security"), F.col("r_name").alias("group_id")
    )


def nation_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_returns(spark, sf_dir).select("date").distinct()


def nation_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth nation leaves: cash from 1998-07-01, removed on 1999-07-01."""
    rows = table(spark, sf_dir, "nation").where("n_nationkey % 5 = 4")
    return rows.select(F.col("n_name").alias("security"), F.to_date(F.lit("1998-07-01")).alias("cash_start"), F.to_date(F.lit("1999-07-01")).alias("remove"))


def region_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's tickers before and from 1998; the second of AMERICA also maps to its SPINOFF."""
    regions = table(spark, sf_dir, "region").select("r_name")
    d = lambda x: F.to_date(F.lit(x))
    old = regions.select(F.concat("r_name", F.lit("_OLD")).alias("ticker"), F.col("r_name").alias("security"), d("1995-01-01").alias("start"), d("1997-12-31").alias("end"))
    new = regions.select(F.concat("r_name", F.lit("_NEW")).alias("ticker"), F.col("r_name").alias("security"), d("1998-01-01").alias("start"), d("2001-12-31").alias("end"))
    spin = regions.where("r_name = 'AMERICA'").select(F.lit("AMERICA_NEW").alias("ticker"), F.lit("SPINOFF").alias("security"), d("1999-01-01").alias("start"), d("2001-12-31").alias("end"))
    return old.unionByName(new).unionByName(spin)


def region_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, security, date, factor): orders of the largest parts with a return are taken for splits."""
    return _events(spark, sf_dir, "R", 50.0).select("event_id", "security", "date", (F.lit(1.0) + F.col("l_linenumber") / 4).alias("factor"))


def region_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "A", 49.0).select("event_id", "security", "date", (F.col("l_discount") * 100 + 1).alias("amount"))


def _events(spark: SparkSession, sf_dir: str, flag: str, quantity: float) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_quantity") == quantity))
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.col("r_name").alias("security"), F.to_date("l_shipdate").alias("date"), "l_linenumber", "l_discount"
    )


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, ts, value): mean event value by type and hour."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("group_id"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))
