"""Panel assembly from configured documents: segments, manual actions, lifecycle classes, audits, and the rules they keep.

Documents are small tables (one row an action, a mapping, a halt); they meet the panel by joins. What breaks a rule comes out
as issue rows with a code, so that a gate can count them, or fails the run where there is no way on.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import panel
from .quality import finite, numeric_integrity, require_none

# Kinds of manual actions, and of observation that a panel row can have.
ACTION_TYPES = ("literal_split", "stock_dividend", "spin_off", "merger_exchange", "cash_acquisition")
STATUSES = ("observed", "verified_halt", "synthetic_terminal_consideration", "unexplained_missing")
ACTION = (
    "action_id string, security string, event_type string, date date, ticker string, multiplier double, cash double, contingent double, "
    "distributed array<struct<ticker:string,ratio:double>>, event_id string, synthetic_close double, valuation string"
)


def segments(constituents: DataFrame, mappings: DataFrame, start, end) -> DataFrame:
    """(security, ticker, start, end, event): the configured segments of a constituent, or one for the whole sample under its own
    ticker. constituents (security); mappings (security, ticker, start, end, event). Overlaps of one ticker and security fail."""
    day = lambda x: F.to_date(F.lit(x))
    rows = constituents.select("security").join(mappings, "security", "left")
    rows = rows.select(
        "security",
        F.coalesce("ticker", "security").alias("ticker"),
        F.coalesce(F.col("start").cast("date"), day(start)).alias("start"),
        F.coalesce(F.col("end").cast("date"), day(end)).alias("end"),
        F.coalesce("event", F.lit("unchanged_ticker")).alias("event"),
    )
    require_none(panel.segment_overlaps(rows), "overlapping segments")
    return rows


def provider_tickers(constituents: DataFrame, mappings: DataFrame) -> DataFrame:
    """Every ticker to ask the provider for: constituents without a mapping, and all mapped ones."""
    own = constituents.select("security").join(mappings.select("security"), "security", "left_anti").select(F.col("security").alias("ticker"))
    return own.unionByName(mappings.select("ticker")).distinct()


def distributed_tickers(actions: DataFrame) -> DataFrame:
    return actions.select(F.explode("distributed.ticker").alias("ticker")).distinct()


def manual_actions(actions: DataFrame, ancillary: DataFrame, allowed: tuple[str, ...] = ACTION_TYPES) -> DataFrame:
    """Actions with the value of what they distribute, close * ratio summed over the distributed securities. An action of an
    unknown kind, or a distributed security without a close on the day, fails. ancillary (ticker, date, close)."""
    require_none(actions.where(~F.col("event_type").isin(*allowed)).select("action_id", "event_type"), "unsupported kind of action")
    parts = actions.select("action_id", "date", F.explode("distributed").alias("d")).select("action_id", "date", "d.ticker", "d.ratio")
    priced = parts.join(ancillary.select("ticker", "date", "close"), ["ticker", "date"], "left")
    require_none(priced.where("close is null").select("action_id", "ticker", "date"), "no close for a distributed security")
    item = F.struct("ticker", "ratio", "close", (F.col("close") * F.col("ratio")).alias("value"))
    values = priced.groupBy("action_id").agg(F.sum(F.col("close") * F.col("ratio")).alias("distributed_value"), F.to_json(F.sort_array(F.collect_list(item))).alias("components"))
    rows = actions.join(values, "action_id", "left")
    return rows.select(
        "security", "date", F.col("action_id").alias("manual_action_id"), "event_type", F.col("ticker").alias("primary_ticker"), F.col("multiplier").alias("manual_multiplier"),
        F.coalesce("cash", F.lit(0.0)).alias("manual_cash"), F.coalesce("contingent", F.lit(0.0)).alias("contingent_value"), F.coalesce("distributed_value", F.lit(0.0)).alias("distributed_value"),
        F.coalesce("components", F.lit("[]")).alias("components"), "event_id",
    )


def primary_mismatches(prices: DataFrame, manual: DataFrame) -> DataFrame:
    """Days whose price has another ticker than their manual action names."""
    both = prices.select("security", "date", "ticker").join(manual.select("security", "date", "manual_action_id", "primary_ticker"), ["security", "date"])
    return both.where(F.col("ticker") != F.col("primary_ticker"))


def with_synthetic_rows(prices: DataFrame, actions: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """prices (security, date, ticker, close, volume, status) with a row for each action that sets a terminal value. It fails
    where a price was observed on the day, or a value said to be cash plus contingent is not."""
    made = actions.where("synthetic_close is not null")
    require_none(made.join(prices.select("security", "date"), ["security", "date"], "left_semi").select("security", "date"), "a synthetic row overlaps a price")
    parts = F.coalesce("cash", F.lit(0.0)) + F.coalesce("contingent", F.lit(0.0))
    wrong = (F.col("valuation") == "cash_plus_contingent") & (F.abs(F.col("synthetic_close") - parts) > tolerance)
    require_none(made.where(wrong).select("action_id"), "a synthetic close is not cash plus contingent value")
    rows = made.select("security", "date", "ticker", F.col("synthetic_close").alias("close"), F.lit(0).cast(prices.schema["volume"].dataType).alias("volume"), F.lit("synthetic_terminal_consideration").alias("status"))
    return prices.select(*rows.columns).unionByName(rows)


def observed(rows: DataFrame) -> DataFrame:
    """Raw rows with a status, a number or null for the close, and whether they are made up."""
    close = F.expr("try_cast(close as double)")
    status = F.coalesce(F.col("status"), F.lit("observed")) if "status" in rows.columns else F.lit("observed")
    return rows.withColumns({"close": F.when(finite(close), close), "status": status}).withColumn("is_synthetic", F.col("status") != "observed")


def lifecycle(prices: DataFrame, calendar: DataFrame, securities: DataFrame, halts: DataFrame, mapped: DataFrame, actions: DataFrame) -> DataFrame:
    """Every security on every session with its class, its row's values, and the issue or reason there is.

    securities (security, listing, terminal, cash_start, remove); halts (security, date, reason); mapped: segments; actions
    (security, date). Outside its life a security is pre_inception, removed or terminal_cash, and a price then is an issue; up to
    its terminal date it has an active_price, a verified_halt (last close carried, no volume) or is unexplained_missing; after it,
    unexplained_missing. A halt holds only without an action, after a close, and where one segment covers the day."""
    grid = securities.crossJoin(calendar.select("date"))
    rows = (
        grid.join(prices.select("security", "date", "ticker", "close", "volume", "status"), ["security", "date"], "left")
        .join(halts.select("security", "date", F.col("reason").alias("halt_reason"), F.lit(True).alias("halted")), ["security", "date"], "left")
        .join(actions.select("security", "date").distinct().withColumn("acts", F.lit(True)), ["security", "date"], "left")
    )
    own = mapped.select(F.col("security").alias("_s"), F.col("ticker").alias("_t"), "start", "end")
    cover = grid.select("security", "date").join(own, (F.col("security") == F.col("_s")) & F.col("date").between(F.col("start"), F.col("end")))
    rows = rows.join(cover.groupBy("security", "date").agg(F.count("*").alias("covering"), F.first("_t").alias("only_ticker")), ["security", "date"], "left")
    before = Window.partitionBy("security").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    has, life = F.col("status").isNotNull(), F.col("date") <= F.col("terminal")
    one = F.coalesce("covering", F.lit(0)) == 1
    last = F.last(F.when(F.col("date").between(F.col("listing"), F.col("terminal")), F.col("close")), ignorenulls=True).over(before)
    rows = rows.withColumn("last_close", last)
    removed, cash = F.coalesce(F.col("date") >= F.col("remove"), F.lit(False)), F.coalesce(F.col("date") >= F.col("cash_start"), F.lit(False))
    stale = F.coalesce(F.col("halted"), F.lit(False)) & F.col("acts").isNull() & F.col("last_close").isNotNull() & one
    kind = (
        F.when(F.col("date") < F.col("listing"), "pre_inception")
        .when(removed, "removed")
        .when(cash, "terminal_cash")
        .when(~F.coalesce(life, F.lit(True)), "unexplained_missing")
        .when(has, "active_price")
        .when(stale, "verified_halt")
        .otherwise("unexplained_missing")
    )
    rows = rows.withColumn("classification", kind)
    after = ~F.coalesce(life, F.lit(True))
    why = (
        F.when(after, "series ended without terminal-cash or removal classification")
        .when(F.coalesce(F.col("halted"), F.lit(False)) & F.col("acts").isNotNull(), "verified halt overlaps a corporate action and cannot be stale-filled")
        .when(~one, "no unique provider segment covers active session")
        .otherwise("unconfigured active-session absence")
    )
    is_ = lambda x: F.col("classification") == x
    issue = (
        F.when(is_("removed") & has, "observed after removal date")
        .when(is_("terminal_cash") & has, "market row overlaps terminal-cash period")
        .when(is_("unexplained_missing") & after, "unexplained post-terminal absence")
        .when(is_("unexplained_missing"), why)
    )
    halt = is_("verified_halt")
    shown = is_("active_price") | halt | (is_("unexplained_missing") & ~after)
    return rows.select(
        "security", "date", "classification",
        F.when(shown, F.when(has, F.col("ticker")).when(one, F.col("only_ticker"))).alias("ticker"),
        F.when(halt, F.col("last_close")).when(is_("active_price"), F.col("close")).alias("close"),
        F.when(halt, F.lit(0)).when(is_("active_price"), F.col("volume")).alias("volume"),
        F.when(halt, "verified_halt").when(is_("active_price"), F.col("status")).when(shown, "unexplained_missing").alias("status"),
        (shown & ~(is_("active_price") & (F.col("status") == "observed"))).alias("is_synthetic"),
        shown.alias("in_panel"),
        F.when(halt, F.col("halt_reason")).when(is_("unexplained_missing"), why).alias("reason"),
        issue.alias("issue"),
    )


def lifecycle_panel(classified: DataFrame) -> DataFrame:
    return classified.where("in_panel").select("security", "date", "ticker", "close", "volume", "status")


def lifecycle_counts(classified: DataFrame) -> DataFrame:
    """Sessions of each class; prices made of a terminal consideration apart."""
    kind = F.when(F.col("status") == "synthetic_terminal_consideration", F.col("status")).when(F.col("classification") == "active_price", "observed").otherwise(F.col("classification"))
    return classified.groupBy(kind.alias("classification")).agg(F.count("*").alias("sessions"), F.count("issue").alias("issues"))


def unused_halts(halts: DataFrame, classified: DataFrame) -> DataFrame:
    """Configured halts that no session took."""
    return halts.select("security", "date").join(classified.where("classification = 'verified_halt'").select("security", "date"), ["security", "date"], "left_anti")


def event_audit(raw: DataFrame, mapped: DataFrame, manual: DataFrame, kind: str, value: str) -> DataFrame:
    """One row for each raw event and security it maps to: what it counts as, how it is applied, and how many events its
    security has on the day. raw (event_id, ticker, date, value); mapped (event_id, security, date, value); manual (event_id,
    manual_action_id, event_type)."""
    typed = "literal_split" if kind == "split" else "cash_dividend"
    known = mapped.select("event_id", "security", "date", F.col(value).alias("value"), F.count("*").over(Window.partitionBy("security", "date")).alias("aggregation_count"))
    rows = raw.select("event_id", F.col("ticker").alias("provider_ticker"), F.col("date").alias("raw_date")).join(known, "event_id", "left")
    one = manual.groupBy("event_id").agg(F.min(F.struct("manual_action_id", F.col("event_type").alias("manual_type"))).alias("m"))
    rows = rows.join(one.select("event_id", "m.*"), "event_id", "left")
    there = F.col("security").isNotNull()
    method = F.when(~there, "not_applicable").when(F.col("manual_action_id").isNotNull(), "manual_action_replacement").otherwise("provider_event_aggregation")
    return rows.select(
        "event_id", F.lit(kind).alias("event_type"), "provider_ticker", "security", F.coalesce("date", "raw_date").alias("date"),
        F.when(there, F.coalesce("manual_type", F.lit(typed))).otherwise(typed).alias("typed_event"), method.alias("application_method"),
        F.when(there, F.col("manual_action_id")).alias("manual_action_id"), F.coalesce("aggregation_count", F.lit(0).cast("long")).alias("aggregation_count"),
        F.when(there, "mapped").otherwise("out_of_segment").alias("mapping_status"), "value",
    )


def combined_actions(raw_splits: DataFrame, raw_dividends: DataFrame, mapped: DataFrame, manual: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(splits by day, dividends by day, audit of every event). raw_*: (event_id, ticker, date, factor or amount); mapped: segments.
    Splits that a manual action replaces leave the arithmetic and stay in the audit."""
    splits, dividends = (panel.map_segments(x, mapped, check=False) for x in (raw_splits, raw_dividends))
    named = manual.where("event_id is not null").select("event_id", "manual_action_id", "event_type")
    audit = event_audit(raw_splits, splits, named, "split", "factor").unionByName(event_audit(raw_dividends, dividends, named, "dividend", "amount"))
    return panel.split_factors(panel.not_superseded(splits, named)), panel.cash_dividends(dividends), audit


def daily_actions(raw_splits: DataFrame, raw_dividends: DataFrame, mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same without manual actions and without the audit."""
    none = raw_splits.limit(0).select("event_id", F.lit("").alias("manual_action_id"), F.lit("").alias("event_type"))
    return combined_actions(raw_splits, raw_dividends, mapped, none)[:2]


def flag_counts(daily: DataFrame) -> DataFrame:
    return daily.select(F.explode(F.filter(F.split("quality_flag", ";"), lambda x: x != "")).alias("flag")).groupBy("flag").agg(F.count("*").alias("rows"))


def quality_report(
    daily: DataFrame, coverage: DataFrame, classified: DataFrame, events: DataFrame, expected_actions: set[str], reviews: dict[str, str], exit_issues: list[str], extreme_issues: list[str]
) -> dict:
    """The gate of the panel: counts, and pass, conditional_pass (only reviews are open) or fail. events: (disposition)."""
    sums = daily.agg(F.count("*").alias("n"), F.countDistinct("security", "date").alias("keys"), F.count_if(F.col("close") <= 0).alias("nonpositive"), F.count_if(F.col("log_total_return").isNull()).alias("missing")).first()
    applied = {r[0] for r in daily.where("manual_action_id is not null").select("manual_action_id").distinct().collect()}
    dispositions = {r.disposition: r["count"] for r in events.groupBy("disposition").count().collect()}
    numbers = numeric_integrity(daily).first().asDict()
    numbers.pop("n_rows")
    issues = classified.where("issue is not null").count()
    missing = sorted(expected_actions - applied)
    unresolved = sorted(t for t, status in reviews.items() if not status.startswith("resolved"))
    failing = (sums.n - sums["keys"], sums.nonpositive, missing, exit_issues, issues, dispositions.get("unmatched_price", 0), dispositions.get("unclassified", 0), extreme_issues, any(numbers.values()))
    included = coverage.groupBy("included").count().collect()
    return {
        "schema_version": 2,
        "duplicate_security_dates": sums.n - sums["keys"],
        "nonpositive_closes": sums.nonpositive,
        "missing_log_returns": sums.missing,
        "quality_flag_counts": {r.flag: r.rows for r in flag_counts(daily).orderBy("flag").collect()},
        "candidate_securities": sum(r["count"] for r in included),
        "included_securities": sum(r["count"] for r in included if r.included),
        "missing_manual_action_ids": missing,
        "applied_manual_action_ids": sorted(applied),
        "unresolved_event_reviews": unresolved,
        "lifecycle_issues": issues,
        "numeric_integrity": numbers,
        "reference_event_disposition_counts": dict(sorted(dispositions.items())),
        "gate_status": "fail" if any(failing) else "conditional_pass" if unresolved else "pass",
    }


def universe_freeze(constituents: DataFrame, coverage: DataFrame, least: float, sample: tuple[str, str]) -> dict:
    """The frozen universe: every candidate with its coverage and why it is left out, included tickers apart, and a digest."""
    shares = ("price_coverage", "return_coverage")
    rows = constituents.join(coverage.select("security", *shares, "included"), "security", "left").orderBy("security")
    out = []
    for r in rows.collect():
        short = [x for x in shares if (getattr(r, x) or 0.0) < least]
        out.append(r.asDict() | {"included": bool(r.included), "exclusion_reason": None if r.included else "no_observations" if r.price_coverage is None else "below_minimum_" + "_and_".join(short)})
    body = json.dumps(out, sort_keys=True, separators=(",", ":"), default=str)
    return {
        "schema_version": 2, "sample_start": sample[0], "sample_end": sample[1], "minimum_initial_coverage": least, "constituents": out,
        "included_tickers": [r["security"] for r in out if r["included"]], "sha256": hashlib.sha256(body.encode()).hexdigest(),
    }


def panel_problems(rows: DataFrame) -> list[str]:
    """Codes of what keeps a long panel (security, date, simple_return) from being used."""
    sums = rows.agg(F.count("*").alias("n"), F.countDistinct("security", "date").alias("keys"), F.count_if(F.col("date").isNull()).alias("no_date"), F.count_if(F.col("security").isNull()).alias("no_name")).first()
    tests = ((sums.n == 0, "empty_panel"), (sums.no_date > 0, "missing_date"), (sums.no_name > 0, "missing_security"), (sums.n - sums.no_date > sums["keys"] and sums.no_name == 0, "repeated_security_date"))
    return [code for bad, code in tests if bad]


def annual_set_issues(schedule: DataFrame, known: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(year, code, securities): what is wrong with annual active sets. schedule (year, rebalance_date, active array, security_count);
    known: securities that the panel has; labels: those that have a group."""
    order = Window.orderBy("year")
    distinct = F.array_distinct(F.coalesce("active", F.array().cast("array<string>")))
    rows = schedule.withColumns({"active_set": distinct, "previous_year": F.lag("year").over(order), "previous_set": F.lag(distinct).over(order)})
    names = known.agg(F.collect_set("security").alias("known"))
    rows = rows.join(names).join(labels.agg(F.collect_set("security").alias("labelled"))) if labels is not None else rows.join(names).withColumn("labelled", F.col("known"))
    none = F.array().cast("array<string>")
    later = F.when(F.col("previous_set").isNotNull(), F.array_except("active_set", "previous_set")).otherwise(none)
    missing, unlabelled = F.array_except("active_set", "known"), F.array_except("active_set", "labelled")

    def found(test: Column, code: str, which: Column = none) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.sort_array(which).alias("securities")))

    size = F.size("active_set")
    codes = F.array(
        found(F.col("year") == F.col("previous_year"), "duplicate_year"),
        found((F.col("year") != F.col("previous_year")) & (F.col("year") != F.col("previous_year") + 1), "nonconsecutive_year"),
        found(size == 0, "empty_annual_active_set"),
        found(F.size("active") > size, "duplicate_annual_active_security"),
        found((size > 0) & ~F.col("security_count").eqNullSafe(F.size("active").cast("long")), "annual_security_count_mismatch"),
        found(F.size(missing) > 0, "active_security_missing_from_panel", missing),
        found(F.size(unlabelled) > 0, "active_security_missing_group_label", unlabelled),
        found(F.size(later) > 0, "later_addition", later),
        found(F.col("rebalance_date").isNull() | (F.year("rebalance_date") != F.col("year")), "out_of_year_rebalance_date"),
    )
    return rows.select("year", F.explode(F.array_compact(codes)).alias("x")).select("year", "x.code", "x.securities")


def incomplete_days(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """(year, date, missing): days on which a year's active set has missing or non-finite returns, but for the panel's first
    day if no return is there at all. rows (security, date, simple_return); schedule (year, security)."""
    first = rows.agg(F.min("date").alias("first"))
    sizes = schedule.groupBy("year").agg(F.count("*").alias("active"))
    dates = rows.select("date").distinct().withColumn("year", F.year("date")).join(sizes, "year")
    good = rows.where(finite(F.col("simple_return"))).withColumn("year", F.year("date")).join(schedule.select("year", "security"), ["year", "security"])
    counted = dates.join(good.groupBy("date").agg(F.count("*").alias("present")), "date", "left").join(first)
    present = F.coalesce("present", F.lit(0).cast("long"))
    allowed = (F.col("date") == F.col("first")) & (present == 0)
    return counted.where((present < F.col("active")) & ~allowed).select("year", "date", (F.col("active") - present).alias("missing"))


def identity_audit(rows: DataFrame, schedule: DataFrame, labels: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """By year, over complete days: the largest difference of the mean over securities and the size-weighted mean over groups,
    days, incomplete days, and whether the identity holds."""
    year_rows = rows.where(finite(F.col("simple_return"))).withColumn("year", F.year("date")).join(schedule.select("year", "security"), ["year", "security"])
    sizes = schedule.groupBy("year").agg(F.count("*").alias("active"))
    cells = year_rows.join(labels.select("security", "group_id"), "security").groupBy("year", "date", "group_id").agg(F.sum("simple_return").alias("total"), F.count("*").alias("n"))
    days = cells.groupBy("year", "date").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum((F.col("total") / F.col("n")) * F.col("n")).alias("weighted")
    )
    whole = days.join(sizes, "year").withColumn("complete", F.col("n") == F.col("active"))
    gap = F.abs(F.col("total") / F.col("n") - F.col("weighted") / F.col("n"))
    out = whole.groupBy("year").agg(F.max(F.when(F.col("complete"), gap)).alias("max_error"), F.count_if("complete").alias("days"), F.count_if(~F.col("complete")).alias("incomplete_days"))
    return out.withColumn("status", F.when((F.col("days") > 0) & (F.col("max_error") <= tolerance), "pass").otherwise("fail"))
