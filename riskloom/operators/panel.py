"""Building a lifecycle-complete total-return panel from raw prices, ticker segments and corporate actions.

Everything is a DataFrame plan: joins on (security, date), windows by security, ordered case expressions. Segments, exits and
action registries are small by nature but are joined without hints; the planner broadcasts them when their size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import require_unique

EXTREME = 0.40


def _by_security():
    return Window.partitionBy("security").orderBy("date")


def map_segments(rows: DataFrame, segments: DataFrame, check: bool = True) -> DataFrame:
    """Interval join: rows (ticker, date, ...) with segments (ticker, security, start, end), both ends inside. A row may map
    to several securities; a security that gets two rows on a date is an error."""
    s = segments.select(F.col("ticker").alias("_ticker"), "security", F.col("start").alias("_start"), F.col("end").alias("_end"))
    mapped = rows.join(s, (F.col("ticker") == F.col("_ticker")) & F.col("date").between(F.col("_start"), F.col("_end"))).drop("_ticker", "_start", "_end")
    if check:
        require_unique(mapped, ["security", "date"], "mapped rows")
    return mapped


def segment_overlaps(segments: DataFrame) -> DataFrame:
    """Segments of one ticker and security that begin before the one before has ended."""
    order = Window.partitionBy("ticker", "security").orderBy("start")
    return segments.withColumn("previous_end", F.lag("end").over(order)).where(F.col("previous_end") >= F.col("start"))


def split_factors(splits: DataFrame) -> DataFrame:
    return splits.groupBy("security", "date").agg(F.product("factor").alias("split_factor"), F.count("*").alias("split_events"))


def cash_dividends(dividends: DataFrame) -> DataFrame:
    return dividends.groupBy("security", "date").agg(F.sum("amount").alias("cash_dividend"), F.count("*").alias("dividend_events"))


def not_superseded(events: DataFrame, manual: DataFrame) -> DataFrame:
    """Provider events that no manual action replaces, by event id."""
    return events.join(manual.select("event_id"), "event_id", "left_anti")


def event_dispositions(raw: DataFrame, mapped: DataFrame, prices: DataFrame) -> DataFrame:
    """Each raw event's fate: out_of_segment, unmatched_price, duplicate_aggregated, applied; first that holds."""
    m = mapped.select("event_id", "security", "date")
    count = F.count("*").over(Window.partitionBy("security", "date"))
    keyed = m.withColumn("same_day", count).join(prices.select("security", "date", F.lit(True).alias("priced")), ["security", "date"], "left")
    joined = raw.select("event_id").join(keyed.drop("date"), "event_id", "left")
    fate = (
        F.when(F.col("security").isNull(), "out_of_segment")
        .when(F.col("priced").isNull(), "unmatched_price")
        .when(F.col("same_day") > 1, "duplicate_aggregated")
        .otherwise("applied")
    )
    return joined.select("event_id", "security", fate.alias("disposition"))


def total_returns(prices: DataFrame, splits: DataFrame, dividends: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """prices (security, date, ticker, close, status) with daily actions -> gross, simple and log total return and flags.

    The consideration of a day is multiplier * close + split * dividend + cash + contingent + distributed, where the
    multiplier is the manual one or else the split factor; the gross return divides it by the day before's close and is
    null where that is missing or not positive.
    """
    rows = prices.join(splits.select("security", "date", "split_factor"), ["security", "date"], "left").join(
        dividends.select("security", "date", "cash_dividend"), ["security", "date"], "left"
    )
    columns = {"manual_multiplier": "double", "manual_cash": "double", "contingent_value": "double", "distributed_value": "double", "manual_action_id": "string"}
    if manual is not None:
        rows = rows.join(manual.select("security", "date", *[c for c in columns if c in manual.columns]), ["security", "date"], "left")
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})
    if "status" not in rows.columns:
        rows = rows.withColumn("status", F.lit("observed"))
    split, close = F.coalesce("split_factor", F.lit(1.0)), F.col("close")
    consideration = (
        F.coalesce("manual_multiplier", split) * close
        + split * F.coalesce("cash_dividend", F.lit(0.0))
        + F.coalesce("manual_cash", F.lit(0.0))
        + F.coalesce("contingent_value", F.lit(0.0))
        + F.coalesce("distributed_value", F.lit(0.0))
    )
    rows = rows.withColumns(
        {"previous_close": F.lag("close").over(_by_security()), "previous_ticker": F.lag("ticker").over(_by_security()), "previous_status": F.lag("status").over(_by_security()), "consideration": consideration}
    )
    ratio = F.col("consideration") / F.col("previous_close")
    gross = F.when((F.col("previous_close") > 0) & (close > 0) & (ratio > 0), ratio)
    raw = close / F.col("previous_close") - 1
    flag = lambda test, name: F.when(test, F.lit(name))
    flags = F.concat_ws(
        ";",
        flag(close <= 0, "nonpositive_close"),
        flag(F.col("ticker") != F.col("previous_ticker"), "ticker_segment_transition"),
        flag(F.col("manual_action_id").isNotNull(), "manual_corporate_action"),
        flag(F.col("status") == "verified_halt", "verified_halt_zero_return"),
        flag((F.col("previous_status") == "verified_halt") & (F.col("status") == "observed"), "gap_bridge_return"),
        flag(F.col("status") == "synthetic_terminal", "synthetic_terminal_consideration"),
        flag(F.col("status") == "unexplained_missing", "unexplained_missing_active_day"),
        flag(F.abs(gross - 1) > EXTREME, "extreme_total_return"),
        flag((F.abs(raw) > EXTREME) & F.col("split_factor").isNull(), "extreme_unadjusted_return_without_split"),
    )
    return rows.withColumns({"gross_return": gross, "total_return": gross - 1, "log_total_return": F.log(gross), "quality_flag": flags})


def lifecycle_grid(prices: DataFrame, calendar: DataFrame, securities: DataFrame, halts: DataFrame) -> DataFrame:
    """Every security on every session: observed, a verified halt (last close carried, no volume), terminal cash, outside its
    life, or unexplained. securities: (security, listing, terminal, cash_start, remove), the last three may be null; halts:
    (security, date)."""
    rows = (
        securities.crossJoin(calendar.select("date"))
        .join(prices.select("security", "date", "ticker", "close", "volume"), ["security", "date"], "left")
        .join(halts.select("security", "date", F.lit(True).alias("halted")), ["security", "date"], "left")
    )
    before = _by_security().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last_close", F.last("close", ignorenulls=True).over(before))
    status = (
        F.when(F.col("date") < F.col("listing"), "pre_inception")
        .when(F.col("date") >= F.col("remove"), "removed")
        .when(F.col("date") >= F.col("cash_start"), "terminal_cash")
        .when(F.col("close").isNotNull(), "observed")
        .when(F.col("halted") & F.col("last_close").isNotNull(), "verified_halt")
        .when(F.col("terminal").isNotNull() & (F.col("date") > F.col("terminal")), "after_terminal")
        .otherwise("unexplained_missing")
    )
    rows = rows.withColumn("status", status)
    halt = F.col("status") == "verified_halt"
    return rows.withColumns(
        {"close": F.when(halt, F.col("last_close")).otherwise(F.col("close")), "volume": F.when(halt, F.lit(0)).otherwise(F.col("volume"))}
    ).select("security", "date", "ticker", "close", "volume", "status")


def coverage(daily: DataFrame, calendar: DataFrame, least: float = 0.95) -> DataFrame:
    """Observed shares of sessions and of the returns between them, and whether both reach ``least``."""
    n = calendar.agg(F.count("*").alias("sessions"))
    seen = daily.join(calendar.select("date"), "date").groupBy("security").agg(F.count("close").alias("price_days"), F.count("log_total_return").alias("return_days"))
    rows = seen.join(n).withColumns(
        {"price_coverage": F.col("price_days") / F.col("sessions"), "return_coverage": F.col("return_days") / (F.col("sessions") - 1)}
    )
    return rows.withColumn("included", (F.col("price_coverage") >= least) & (F.col("return_coverage") >= least))


def early_exits(daily: DataFrame, exits: DataFrame, sample_end) -> DataFrame:
    """Securities whose last observation is before the sample's end, beside the configured exits; either side may miss."""
    last = daily.where("close is not null").groupBy("security").agg(F.max("date").alias("last_date")).where(F.col("last_date") < sample_end)
    both = last.join(exits.select("security", F.lit(True).alias("configured")), "security", "full_outer")
    return both.select("security", "last_date", F.when(F.col("configured").isNull(), "unconfigured").when(F.col("last_date").isNull(), "unused").otherwise("matched").alias("finding"))


def extreme_observations(daily: DataFrame, reviews: DataFrame, limit: float = EXTREME) -> DataFrame:
    """Returns beyond ``limit`` with their review, if there is one."""
    found = daily.where(F.abs("total_return") > limit).select("security", "date", "total_return")
    return found.join(reviews.select("security", "date", "review"), ["security", "date"], "left").withColumn("reviewed", F.col("review").isNotNull())


def carry_cash(panel: DataFrame, exits: DataFrame) -> DataFrame:
    """Zero returns from an exit's cash_start until before its remove date; a market return in that time fails the run."""
    e = exits.select(F.col("security").alias("_s"), "cash_start", "remove")
    rows = panel.join(e, (F.col("security") == F.col("_s")) & (F.col("date") >= F.col("cash_start")) & (F.col("date") < F.col("remove")), "left")
    overlap = F.raise_error(F.concat_ws(" ", F.lit("cash carry overlaps a market return:"), "security", F.col("date").cast("string"))).cast("double")
    carried = F.when(F.col("simple_return").isNull(), F.lit(0.0)).otherwise(overlap)
    return rows.withColumn("simple_return", F.when(F.col("_s").isNotNull(), carried).otherwise(F.col("simple_return"))).drop("_s", "cash_start", "remove")


def rebalance_dates(calendar: DataFrame) -> DataFrame:
    return calendar.groupBy(F.year("date").alias("year")).agg(F.min("date").alias("rebalance_date"))


def active_schedule(included: DataFrame, calendar: DataFrame, exits: DataFrame) -> DataFrame:
    """(year, rebalance_date, security): included securities whose removal lies after the year's first session."""
    rows = rebalance_dates(calendar).crossJoin(included.select("security")).join(exits.select("security", "remove"), "security", "left")
    return rows.where(F.col("remove").isNull() | (F.col("rebalance_date") < F.col("remove"))).select("year", "rebalance_date", "security")


def late_additions(schedule: DataFrame) -> DataFrame:
    """Securities in a year's set that were not in the year before's, from the second year on."""
    earlier = schedule.select((F.col("year") + 1).alias("year"), "security")
    first = schedule.agg(F.min("year").alias("first"))
    return schedule.join(earlier, ["year", "security"], "left_anti").join(first, F.col("year") > F.col("first")).drop("first")


def composite(panel: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """The two share classes as one half-and-half security; null where either is."""
    pair = panel.where(F.col("security").isin(first, second))
    mixed = pair.groupBy("date").agg((F.sum("simple_return") / 2).alias("simple_return"), F.count("simple_return").alias("n"))
    mixed = mixed.select(F.lit(name).alias("security"), "date", F.when(F.col("n") == 2, F.col("simple_return")).alias("simple_return"))
    return panel.where(~F.col("security").isin(first, second)).select("security", "date", "simple_return").unionByName(mixed)
