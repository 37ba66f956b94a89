"""Queries of panel assembly over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, panel
from ..sources import views as v
from .oracles import EVENTS, EXITS, PRICES, SEGMENTS, TOTAL


def _day(x: str):
    return F.to_date(F.lit(x))


def configured_segments(s, d):
    names = v.table(s, d, "region").select(F.col("r_name").alias("security"))
    mappings = v.region_segments(s, d).where("security not in ('EUROPE', 'SPINOFF')").withColumn("event", F.lit("renamed"))
    return assembly.segments(names, mappings, "1995-01-01", "2001-12-31")


def provider_tickers(s, d):
    names = v.table(s, d, "region").select(F.col("r_name").alias("security"))
    return assembly.provider_tickers(names, v.region_segments(s, d).where("security not in ('EUROPE', 'ASIA')"))


def _actions(s, d):
    """One action for each region on its last price day: it distributes its own ticker and, from the second region on, cash."""
    last = v.region_prices(s, d).groupBy("security").agg(F.max(F.struct("date", "ticker")).alias("x")).select("security", "x.date", "x.ticker")
    rows = last.join(v.table(s, d, "region"), F.col("security") == F.col("r_name"))
    key = F.col("r_regionkey")
    return rows.select(
        F.concat(F.lit("A"), key.cast("string")).alias("action_id"), "security", F.when(key % 2 == 0, "spin_off").otherwise("merger_exchange").alias("event_type"), "date", "ticker",
        (F.lit(1.0) + key).alias("multiplier"), F.when(key > 0, key * 1.5).cast("double").alias("cash"), F.lit(None).cast("double").alias("contingent"),
        F.when(key > 1, F.array(F.struct("ticker", ((key + 1) / 10).alias("ratio")))).alias("distributed"), F.lit(None).cast("string").alias("event_id"),
    )


def manual_action_values(s, d):
    rows = assembly.manual_actions(_actions(s, d), v.region_prices(s, d).select("ticker", "date", "close"))
    return rows.select("security", "date", "manual_action_id", "event_type", "primary_ticker", "manual_multiplier", "manual_cash", "contingent_value", F.round(F.col("distributed_value") + 1.3e-8, 6).alias("distributed_value"))


def _classified(s, d):
    """Fourteenths are missing and configured as halts for odd months; Europe ends in 2000 without a treatment, Asia with one."""
    europe, asia = F.col("r_name") == "EUROPE", F.col("r_name") == "ASIA"
    securities = v.table(s, d, "region").select(
        F.col("r_name").alias("security"), F.date_add(_day("1995-01-10"), F.col("r_regionkey").cast("int")).alias("listing"),
        F.when(europe, _day("2000-12-31")).when(asia, _day("1999-12-31")).otherwise(_day("2001-12-31")).alias("terminal"),
        F.when(asia, _day("2000-01-01")).alias("cash_start"), F.when(asia, _day("2001-01-01")).alias("remove"),
    )
    prices = v.region_prices(s, d)
    halts = prices.where("day(date) = 14 and month(date) % 2 = 1").select("security", "date").withColumn("reason", F.lit("exchange closed"))
    known = prices.where("day(date) <> 14").withColumn("status", F.lit("observed"))
    mapped = v.region_segments(s, d).where("not (security = 'AFRICA' and start >= date'1998-01-01')")
    actions = v.region_dividends(s, d).select("security", "date")
    return assembly.lifecycle(known, prices.select("date").distinct(), securities, halts, mapped, actions)


def lifecycle_classes(s, d):
    return _classified(s, d).withColumn("close", F.round(F.col("close") + 1.3e-8, 6))


def lifecycle_counts(s, d):
    return assembly.lifecycle_counts(_classified(s, d))


def event_audit(s, d):
    raw = v.region_splits(s, d).withColumn("ticker", F.concat("security", F.when(F.year("date") < 1998, "_OLD").otherwise("_NEW"))).drop("security").where("year(date) <> 1997")
    manual = raw.where("event_id % 3 = 0").select("event_id", F.concat(F.lit("M"), F.col("event_id").cast("string")).alias("manual_action_id"), F.lit("spin_off").alias("event_type"))
    dividends = v.region_dividends(s, d).limit(0).withColumn("ticker", F.lit("")).drop("security")
    segments = v.region_segments(s, d).where("security <> 'ASIA'")
    audit = assembly.combined_actions(raw, dividends, segments, manual)[2]
    return audit.withColumn("value", F.round("value", 6))


def applied_splits(s, d):
    raw = v.region_splits(s, d).withColumn("ticker", F.concat("security", F.when(F.year("date") < 1998, "_OLD").otherwise("_NEW"))).drop("security")
    manual = raw.where("event_id % 3 = 0").select("event_id", F.lit("M").alias("manual_action_id"), F.lit("spin_off").alias("event_type"))
    dividends = v.region_dividends(s, d).withColumn("ticker", F.concat("security", F.when(F.year("date") < 1998, "_OLD").otherwise("_NEW"))).drop("security")
    splits, _, _ = assembly.combined_actions(raw, dividends, v.region_segments(s, d), manual)
    return splits.withColumn("split_factor", F.round("split_factor", 6))


def flag_counts(s, d):
    daily = panel.total_returns(v.region_prices(s, d), panel.split_factors(v.region_splits(s, d)), panel.cash_dividends(v.region_dividends(s, d)))
    return assembly.flag_counts(daily)


def annual_set_issues(s, d):
    """Sets of nations with planted faults: 1996 has its first name twice, 1997 a wrong count, 1998 a name that no panel has, 1999 a
    rebalance date of another year, 2000 is missing."""
    schedule = panel.active_schedule(v.nation_returns(s, d).select("security").distinct(), v.nation_calendar(s, d), v.nation_exits(s, d))
    rows = schedule.groupBy("year", "rebalance_date").agg(F.sort_array(F.collect_list("security")).alias("active")).withColumn("security_count", F.size("active").cast("long"))
    year = F.col("year")
    rows = rows.where("year <> 2000").withColumns(
        {
            "active": F.when(year == 1996, F.concat("active", F.slice("active", 1, 1))).when(year == 1998, F.concat("active", F.array(F.lit("ATLANTIS")))).otherwise(F.col("active")),
            "security_count": F.col("security_count") + F.when(year.isin(1996, 1997, 1998), 1).otherwise(0),
            "rebalance_date": F.when(year == 1999, F.date_add("rebalance_date", 400)).otherwise(F.col("rebalance_date")),
        }
    )
    found = assembly.annual_set_issues(rows, v.nation_returns(s, d).select("security").distinct())
    return found.withColumn("securities", F.concat_ws(",", "securities"))


def _annual(s, d):
    return panel.active_schedule(v.nation_returns(s, d).select("security").distinct(), v.nation_calendar(s, d), v.nation_exits(s, d)).select("year", "security")


def incomplete_days(s, d):
    return assembly.incomplete_days(v.nation_returns(s, d).where("day(date) + month(date) <> 5 or security <> 'NATION_1'"), _annual(s, d))


def identity_audit(s, d):
    return assembly.identity_audit(v.nation_returns(s, d), _annual(s, d), v.nation_labels(s, d)).withColumn("max_error", F.round("max_error", 9))


def queries() -> dict:
    return {f.__name__: f for f in (
        configured_segments, provider_tickers, manual_action_values, lifecycle_classes, lifecycle_counts, event_audit, applied_splits, flag_counts, annual_set_issues, incomplete_days, identity_audit,
    )}


_CLASSES = PRICES + ", " + SEGMENTS + """,
div AS (SELECT DISTINCT r_name AS security, CAST(l_shipdate AS DATE) AS date FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'A' AND l_quantity = 49),
sec AS (SELECT r_name AS security, DATE '1995-01-10' + CAST(r_regionkey AS INTEGER) AS listing,
        CASE r_name WHEN 'EUROPE' THEN DATE '2000-12-31' WHEN 'ASIA' THEN DATE '1999-12-31' ELSE DATE '2001-12-31' END AS terminal,
        CASE WHEN r_name = 'ASIA' THEN DATE '2000-01-01' END AS cash_start, CASE WHEN r_name = 'ASIA' THEN DATE '2001-01-01' END AS remove FROM region),
g AS (SELECT x.*, c.date, p.ticker, p.close, p.volume, p.date IS NOT NULL AS has, h.date IS NOT NULL AS halted, d.date IS NOT NULL AS acts,
      (SELECT count(*) FROM segments m WHERE m.security = x.security AND c.date BETWEEN m.s AND m.e AND NOT (m.security = 'AFRICA' AND m.s >= DATE '1998-01-01')) AS cover,
      (SELECT max(m.ticker) FROM segments m WHERE m.security = x.security AND c.date BETWEEN m.s AND m.e) AS only_ticker
      FROM sec x CROSS JOIN (SELECT DISTINCT date FROM prices) c LEFT JOIN prices p ON p.security = x.security AND p.date = c.date AND day(c.date) <> 14
      LEFT JOIN prices h ON h.security = x.security AND h.date = c.date AND day(c.date) = 14 AND month(c.date) % 2 = 1 LEFT JOIN div d ON d.security = x.security AND d.date = c.date),
l AS (SELECT *, last_value(CASE WHEN date BETWEEN listing AND terminal THEN close END IGNORE NULLS) OVER (PARTITION BY security ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lc FROM g),
k AS (SELECT *, CASE WHEN date < listing THEN 'pre_inception' WHEN date >= remove THEN 'removed' WHEN date >= cash_start THEN 'terminal_cash' WHEN date > terminal THEN 'unexplained_missing' WHEN has THEN 'active_price'
      WHEN halted AND NOT acts AND lc IS NOT NULL AND cover = 1 THEN 'verified_halt' ELSE 'unexplained_missing' END AS classification FROM l),
w AS (SELECT *, CASE WHEN date > terminal THEN 'series ended without terminal-cash or removal classification' WHEN halted AND acts THEN 'verified halt overlaps a corporate action and cannot be stale-filled'
      WHEN cover <> 1 THEN 'no unique provider segment covers active session' ELSE 'unconfigured active-session absence' END AS why,
      classification IN ('active_price', 'verified_halt') OR (classification = 'unexplained_missing' AND date <= terminal) AS in_panel FROM k),
classes AS (SELECT security, date, classification, CASE WHEN in_panel THEN CASE WHEN has THEN ticker WHEN cover = 1 THEN only_ticker END END AS ticker,
      round(CASE classification WHEN 'verified_halt' THEN lc WHEN 'active_price' THEN close END + 1.3e-8, 6) AS close, CASE classification WHEN 'verified_halt' THEN 0 WHEN 'active_price' THEN volume END AS volume,
      CASE classification WHEN 'verified_halt' THEN 'verified_halt' WHEN 'active_price' THEN 'observed' ELSE CASE WHEN in_panel THEN 'unexplained_missing' END END AS status, in_panel AND classification <> 'active_price' AS is_synthetic, in_panel,
      CASE classification WHEN 'verified_halt' THEN 'exchange closed' WHEN 'unexplained_missing' THEN why END AS reason,
      CASE WHEN classification = 'removed' AND has THEN 'observed after removal date' WHEN classification = 'terminal_cash' AND has THEN 'market row overlaps terminal-cash period'
           WHEN classification = 'unexplained_missing' AND date > terminal THEN 'unexplained post-terminal absence' WHEN classification = 'unexplained_missing' THEN why END AS issue FROM w)"""
_SETS = EXITS + """,
sets AS (SELECT year, CASE WHEN year = 1999 THEN min(rebalance_date) + 400 ELSE min(rebalance_date) END AS rebalance_date, list(security) AS own, count(*) AS n FROM schedule WHERE year <> 2000 GROUP BY year),
planted AS (SELECT year, rebalance_date, CASE WHEN year = 1998 THEN list_append(own, 'ATLANTIS') ELSE own END AS active, n + CASE WHEN year IN (1996, 1997, 1998) THEN 1 ELSE 0 END AS security_count, n + CASE WHEN year IN (1996, 1998) THEN 1 ELSE 0 END AS shown FROM sets),
seen AS (SELECT *, lag(year) OVER (ORDER BY year) AS py, lag(active) OVER (ORDER BY year) AS pa FROM planted)"""


def oracle_sql() -> dict[str, str]:
    return {
        "configured_segments": f"""WITH {SEGMENTS} SELECT r_name AS security, coalesce(s.ticker, r_name) AS ticker, coalesce(s.s, DATE '1995-01-01') AS start, coalesce(s.e, DATE '2001-12-31') AS "end",
            CASE WHEN s.ticker IS NULL THEN 'unchanged_ticker' ELSE 'renamed' END AS event FROM region LEFT JOIN segments s ON s.security = r_name AND r_name <> 'EUROPE'""",
        "provider_tickers": f"WITH {SEGMENTS} SELECT DISTINCT ticker FROM segments WHERE security NOT IN ('EUROPE', 'ASIA') UNION SELECT 'EUROPE' UNION SELECT 'ASIA'",
        "manual_action_values": f"""WITH {PRICES}, last AS (SELECT security, max(date) AS date FROM prices GROUP BY 1)
            SELECT p.security, p.date, 'A' || r_regionkey AS manual_action_id, CASE WHEN r_regionkey % 2 = 0 THEN 'spin_off' ELSE 'merger_exchange' END AS event_type, p.ticker AS primary_ticker, CAST(1 + r_regionkey AS DOUBLE) AS manual_multiplier,
                   CAST(r_regionkey * 1.5 AS DOUBLE) AS manual_cash, CAST(0 AS DOUBLE) AS contingent_value, round(CASE WHEN r_regionkey > 1 THEN p.close * ((r_regionkey + 1) / 10.0) ELSE 0 END + 1.3e-8, 6) AS distributed_value
            FROM prices p JOIN last USING (security, date) JOIN region ON r_name = security""",
        "lifecycle_classes": f"WITH {_CLASSES} SELECT * FROM classes",
        "lifecycle_counts": f"WITH {_CLASSES} SELECT CASE WHEN classification = 'active_price' THEN 'observed' ELSE classification END AS classification, count(*) AS sessions, count(issue) AS issues FROM classes GROUP BY 1",
        "event_audit": f"""WITH {EVENTS}, {SEGMENTS}, raw AS (SELECT event_id, security || CASE WHEN year(date) < 1998 THEN '_OLD' ELSE '_NEW' END AS ticker, date, factor FROM splits WHERE year(date) <> 1997),
            m AS (SELECT r.event_id, g.security, r.date AS mapped_date, r.factor, count(*) OVER (PARTITION BY g.security, r.date) AS k FROM raw r JOIN segments g ON g.ticker = r.ticker AND r.date BETWEEN g.s AND g.e WHERE g.security <> 'ASIA')
            SELECT r.event_id, 'split' AS event_type, r.ticker AS provider_ticker, m.security, coalesce(m.mapped_date, r.date) AS date, CASE WHEN m.security IS NOT NULL AND r.event_id % 3 = 0 THEN 'spin_off' ELSE 'literal_split' END AS typed_event,
                   CASE WHEN m.security IS NULL THEN 'not_applicable' WHEN r.event_id % 3 = 0 THEN 'manual_action_replacement' ELSE 'provider_event_aggregation' END AS application_method,
                   CASE WHEN m.security IS NOT NULL AND r.event_id % 3 = 0 THEN 'M' || r.event_id END AS manual_action_id, coalesce(m.k, 0) AS aggregation_count,
                   CASE WHEN m.security IS NULL THEN 'out_of_segment' ELSE 'mapped' END AS mapping_status, round(m.factor, 6) AS value FROM raw r LEFT JOIN m USING (event_id)""",
        "applied_splits": f"""WITH {EVENTS}, {SEGMENTS}, m AS (SELECT g.security, r.date, r.factor FROM splits r JOIN segments g ON g.ticker = r.security || CASE WHEN year(r.date) < 1998 THEN '_OLD' ELSE '_NEW' END AND r.date BETWEEN g.s AND g.e WHERE r.event_id % 3 <> 0)
            SELECT security, date, round(CAST(product(factor) AS DOUBLE), 6) AS split_factor, count(*) AS split_events FROM m GROUP BY 1, 2""",
        "flag_counts": f"WITH {TOTAL}, f AS (SELECT unnest(string_split(quality_flag, ';')) AS flag FROM daily) SELECT flag, count(*) AS rows FROM f WHERE flag <> '' GROUP BY 1",
        "annual_set_issues": f"""WITH {_SETS} SELECT year, 'nonconsecutive_year' AS code, '' AS securities FROM seen WHERE year <> py + 1
            UNION ALL SELECT year, 'duplicate_annual_active_security', '' FROM seen WHERE year = 1996 UNION ALL SELECT year, 'annual_security_count_mismatch', '' FROM seen WHERE security_count <> shown
            UNION ALL SELECT year, 'active_security_missing_from_panel', 'ATLANTIS' FROM seen WHERE year = 1998 UNION ALL SELECT year, 'active_security_missing_group_label', 'ATLANTIS' FROM seen WHERE year = 1998
            UNION ALL SELECT year, 'later_addition', array_to_string(list_sort(list_filter(active, lambda x: NOT list_contains(pa, x))), ',') FROM seen WHERE pa IS NOT NULL AND len(list_filter(active, lambda x: NOT list_contains(pa, x))) > 0
            UNION ALL SELECT year, 'out_of_year_rebalance_date', '' FROM seen WHERE year(rebalance_date) <> year""",
        "incomplete_days": f"""WITH {EXITS}, p AS (SELECT * FROM panel WHERE day(date) + month(date) <> 5 OR security <> 'NATION_1'), k AS (SELECT year, count(*) AS active FROM schedule GROUP BY 1),
            x AS (SELECT CAST(year(d.date) AS INTEGER) AS year, d.date, count(s.security) AS present FROM (SELECT DISTINCT date FROM p) d LEFT JOIN p ON p.date = d.date LEFT JOIN schedule s ON s.year = year(d.date) AND s.security = p.security GROUP BY 1, 2)
            SELECT year, date, active - present AS missing FROM x JOIN k USING (year) WHERE present < active AND NOT (present = 0 AND date = (SELECT min(date) FROM p))""",
        "identity_audit": f"""WITH {EXITS}, k AS (SELECT year, count(*) AS active FROM schedule GROUP BY 1), x AS (SELECT s.year, p.date, count(*) AS n FROM panel p JOIN schedule s ON s.year = year(p.date) AND s.security = p.security GROUP BY 1, 2)
            SELECT x.year, round(CASE WHEN count(*) FILTER (WHERE n = active) > 0 THEN 0.0 END, 9) AS max_error, count(*) FILTER (WHERE n = active) AS days, count(*) FILTER (WHERE n <> active) AS incomplete_days,
                   CASE WHEN count(*) FILTER (WHERE n = active) > 0 THEN 'pass' ELSE 'fail' END AS status FROM x JOIN k USING (year) GROUP BY 1""",
    }
