"""Rules of panel assembly: each is broken once and must be found."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import assembly, panel
from riskloom.operators.quality import ConstraintError

D = dt.date


def actions(spark, **changes):
    row = {"action_id": "A1", "security": "X", "event_type": "spin_off", "date": D(2020, 1, 3), "ticker": "X", "multiplier": 1.0, "cash": 2.0, "contingent": 0.5, "distributed": [("Y", 0.5), ("Z", 2.0)], "event_id": "e1", "synthetic_close": None, "valuation": None}
    return spark.createDataFrame([tuple((row | changes).values())], assembly.ACTION)


@pytest.fixture(scope="module")
def closes(spark):
    return spark.createDataFrame([("Y", D(2020, 1, 3), 10.0), ("Z", D(2020, 1, 3), 4.0)], "ticker string, date date, close double")


def test_segments_default_and_overlap(spark):
    names = spark.createDataFrame([("A",), ("B",)], "security string")
    schema = "security string, ticker string, start string, end string, event string"
    rows = {tuple(r) for r in assembly.segments(names, spark.createDataFrame([("A", "A1", "2017-01-01", "2018-01-01", "renamed"), ("A", "A2", "2018-01-02", "2020-01-01", "renamed")], schema), "2017-01-01", "2020-01-01").collect()}
    assert ("B", "B", D(2017, 1, 1), D(2020, 1, 1), "unchanged_ticker") in rows and len(rows) == 3
    with pytest.raises(ConstraintError):
        assembly.segments(names, spark.createDataFrame([("A", "A1", "2017-01-01", "2018-01-01", "x"), ("A", "A1", "2018-01-01", "2020-01-01", "y")], schema), "2017-01-01", "2020-01-01")


def test_manual_actions(spark, closes):
    row = assembly.manual_actions(actions(spark), closes).first()
    assert row.distributed_value == 13.0 and row.manual_cash == 2.0 and '"ticker":"Y"' in row.components
    assert {r.ticker for r in assembly.distributed_tickers(actions(spark)).collect()} == {"Y", "Z"}
    for bad in ({"event_type": "gift"}, {"distributed": [("W", 1.0)]}):
        with pytest.raises(ConstraintError):
            assembly.manual_actions(actions(spark, **bad), closes)


def test_synthetic_rows(spark):
    prices = spark.createDataFrame([("X", D(2020, 1, 2), "X", 3.0, 10, "observed")], "security string, date date, ticker string, close double, volume int, status string")
    good = actions(spark, synthetic_close=2.5, valuation="cash_plus_contingent")
    rows = assembly.with_synthetic_rows(prices, good).orderBy("date").collect()
    assert [(r.close, r.status) for r in rows] == [(3.0, "observed"), (2.5, "synthetic_terminal_consideration")]
    for bad in ({"synthetic_close": 2.6, "valuation": "cash_plus_contingent"}, {"synthetic_close": 2.5, "date": D(2020, 1, 2)}):
        with pytest.raises(ConstraintError):
            assembly.with_synthetic_rows(prices, actions(spark, **bad))
    manual = assembly.manual_actions(actions(spark, distributed=[], ticker="OTHER", date=D(2020, 1, 2)), prices)
    assert assembly.primary_mismatches(prices, manual).count() == 1


def test_observed_rows(spark):
    rows = assembly.observed(spark.createDataFrame([("1.5", None), ("x", "verified_halt"), ("NaN", "observed")], "close string, status string")).collect()
    assert [(r.close, r.status, r.is_synthetic) for r in rows] == [(1.5, "observed", False), (None, "verified_halt", True), (None, "observed", False)]


def test_lifecycle_rules(spark):
    days = [D(2020, 1, 1) + dt.timedelta(days=k) for k in range(8)]
    calendar = spark.createDataFrame([(x,) for x in days], "date date")
    names = spark.createDataFrame([("X", days[1], days[5], days[6], days[7]), ("Y", days[0], days[3], None, None)], "security string, listing date, terminal date, cash_start date, remove date")
    prices = spark.createDataFrame([(s, x, s, 1.0 + k, 5, "observed") for s, ks in (("X", (1, 6, 7)), ("Y", (0, 3))) for k in ks for x in (days[k],)], "security string, date date, ticker string, close double, volume int, status string")
    halts = spark.createDataFrame([("X", days[2], "storm"), ("X", days[3], "storm"), ("Y", days[1], "storm")], "security string, date date, reason string")
    mapped = spark.createDataFrame([("X", "X", days[0], days[4]), ("Y", "Y", days[0], days[7])], "security string, ticker string, start date, end date")
    acts = spark.createDataFrame([("X", days[3])], "security string, date date")
    rows = {(r.security, (r.date - days[0]).days): r for r in assembly.lifecycle(prices, calendar, names, halts, mapped, acts).collect()}
    assert len(rows) == 16
    kinds = [rows["X", k].classification for k in range(8)]
    assert kinds == ["pre_inception", "active_price", "verified_halt", "unexplained_missing", "unexplained_missing", "unexplained_missing", "terminal_cash", "removed"]
    assert rows["X", 2].close == 2.0 and rows["X", 2].volume == 0 and rows["X", 2].reason == "storm"
    assert "overlaps a corporate action" in rows["X", 3].issue and rows["X", 4].issue == "unconfigured active-session absence"
    assert rows["X", 5].issue == "no unique provider segment covers active session"
    assert "terminal-cash" in rows["X", 6].issue and "after removal" in rows["X", 7].issue
    assert rows["Y", 1].classification == "verified_halt" and rows["Y", 4].issue == "unexplained post-terminal absence" and not rows["Y", 4].in_panel
    classified = assembly.lifecycle(prices, calendar, names, halts, mapped, acts)
    assert assembly.unused_halts(halts, classified).count() == 1 and assembly.lifecycle_panel(classified).where("security = 'X'").count() == 5


def test_cash_carry_must_not_overlap(spark):
    exits = spark.createDataFrame([("X", D(2020, 1, 2), D(2020, 1, 4))], "security string, cash_start date, remove date")
    rows = lambda r: spark.createDataFrame([("X", D(2020, 1, k), r if k == 3 else None if k == 2 else 0.1) for k in (1, 2, 3, 4)], "security string, date date, simple_return double")
    assert [r.simple_return for r in panel.carry_cash(rows(None), exits).orderBy("date").collect()] == [0.1, 0.0, 0.0, 0.1]
    with pytest.raises(Exception, match="cash carry overlaps"):
        panel.carry_cash(rows(0.2), exits).collect()


def test_event_audit_and_arithmetic(spark):
    raw = spark.createDataFrame([("e1", "X", D(2020, 1, 3), 2.0), ("e2", "X", D(2020, 1, 3), 3.0), ("e3", "Q", D(2020, 1, 3), 4.0)], "event_id string, ticker string, date date, factor double")
    dividends = spark.createDataFrame([("e4", "X", D(2020, 1, 3), 0.5)], "event_id string, ticker string, date date, amount double")
    mapped = spark.createDataFrame([("X", "X", D(2020, 1, 1), D(2020, 2, 1))], "security string, ticker string, start date, end date")
    manual = spark.createDataFrame([("A1", "e1", "spin_off")], "manual_action_id string, event_id string, event_type string")
    splits, cash, audit = assembly.combined_actions(raw, dividends, mapped, manual)
    assert splits.first().split_factor == 3.0 and cash.first().cash_dividend == 0.5
    rows = {r.event_id: r for r in audit.collect()}
    assert (rows["e1"].typed_event, rows["e1"].application_method, rows["e1"].aggregation_count) == ("spin_off", "manual_action_replacement", 2)
    assert (rows["e2"].typed_event, rows["e3"].mapping_status, rows["e4"].typed_event) == ("literal_split", "out_of_segment", "cash_dividend")
    assert assembly.daily_actions(raw, dividends, mapped)[0].first().split_factor == 6.0


def test_quality_gate(spark):
    daily = spark.createDataFrame([("X", D(2020, 1, k), 1.0, 1.0, 1.0, 1.0, 5, 0.0, "A1" if k == 1 else None, "extreme_total_return;gap_bridge_return" if k == 2 else "") for k in (1, 2)], "security string, date date, open double, high double, low double, close double, volume int, log_total_return double, manual_action_id string, quality_flag string")
    coverage = spark.createDataFrame([("X", 1.0, 1.0, True), ("Y", 0.5, 0.99, False)], "security string, price_coverage double, return_coverage double, included boolean")
    classified = spark.createDataFrame([("X", None)], "security string, issue string")
    events = spark.createDataFrame([("applied",)], "disposition string")
    report = lambda **c: assembly.quality_report(**({"daily": daily, "coverage": coverage, "classified": classified, "events": events, "expected_actions": {"A1"}, "reviews": {}, "exit_issues": [], "extreme_issues": []} | c))
    good = report()
    assert good["gate_status"] == "pass" and good["quality_flag_counts"] == {"extreme_total_return": 1, "gap_bridge_return": 1} and good["included_securities"] == 1
    assert report(reviews={"X": "open"})["gate_status"] == "conditional_pass"
    for bad in ({"expected_actions": {"A1", "A2"}}, {"daily": daily.unionByName(daily)}, {"exit_issues": ["x"]}, {"classified": classified.withColumn("issue", F.lit("x"))}, {"events": events.withColumn("disposition", F.lit("unmatched_price"))}, {"daily": daily.withColumn("volume", F.lit(-1))}):
        assert report(**bad)["gate_status"] == "fail"
    frozen = assembly.universe_freeze(spark.createDataFrame([("X",), ("Y",), ("Z",)], "security string"), coverage, 0.95, ("2017-01-03", "2025-12-31"))
    assert frozen["included_tickers"] == ["X"] and [r["exclusion_reason"] for r in frozen["constituents"]] == [None, "below_minimum_price_coverage", "no_observations"]


def test_panel_problems_and_sets(spark):
    schema = "security string, date date, simple_return double"
    good = spark.createDataFrame([("X", D(2020, 1, 1), 0.1)], schema)
    assert assembly.panel_problems(good) == [] and assembly.panel_problems(good.limit(0)) == ["empty_panel"]
    assert assembly.panel_problems(good.unionByName(good)) == ["repeated_security_date"]
    assert "missing_date" in assembly.panel_problems(good.withColumn("date", F.lit(None).cast("date")))
    sets = lambda *rows: spark.createDataFrame(rows, "year int, rebalance_date date, active array<string>, security_count long")
    known, labels = (spark.createDataFrame([(x,) for x in xs], "security string") for xs in ("XYZ", "XY"))
    found = {(r.year, r.code) for r in assembly.annual_set_issues(sets((2020, D(2020, 1, 2), ["X", "Z"], 2), (2021, D(2021, 1, 4), ["X", "Y"], 2), (2023, D(2022, 1, 3), [], 0)), known, labels).collect()}
    assert found == {(2020, "active_security_missing_group_label"), (2021, "later_addition"), (2023, "nonconsecutive_year"), (2023, "empty_annual_active_set"), (2023, "out_of_year_rebalance_date")}
