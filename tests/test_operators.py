"""Operators on small tables with results worked out by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import special
from riskloom.functions.scoring import pinball
from riskloom.operators import calendar, cluster, copula, inference, margins, panel, portfolio, quality, risk


def day(text):
    return dt.date.fromisoformat(text)


def prices(spark):
    rows = [("X", day("2020-01-02"), "OLD", 100.0, 5), ("X", day("2020-01-03"), "NEW", 51.0, 5), ("X", day("2020-01-06"), "NEW", 49.0, 5)]
    return spark.createDataFrame(rows, "security string, date date, ticker string, close double, volume long")


def test_total_return_with_split_and_dividend(spark):
    splits = panel.split_factors(spark.createDataFrame([("X", day("2020-01-03"), 2.0)], "security string, date date, factor double"))
    dividends = panel.cash_dividends(spark.createDataFrame([("X", day("2020-01-06"), 2.0)], "security string, date date, amount double"))
    rows = panel.total_returns(prices(spark), splits, dividends).orderBy("date").collect()
    assert rows[0].total_return is None and rows[1].total_return == pytest.approx(0.02) and rows[2].total_return == pytest.approx(0.0)
    assert "ticker_segment_transition" in rows[1].quality_flag and rows[2].quality_flag == ""


def test_manual_action_consideration(spark):
    p = spark.createDataFrame([("X", day("2020-01-02"), "A", 100.0, 1), ("X", day("2020-01-03"), "A", 70.0, 1)], "security string, date date, ticker string, close double, volume long")
    none = spark.createDataFrame([], "security string, date date, split_factor double")
    cash = spark.createDataFrame([], "security string, date date, cash_dividend double")
    manual = spark.createDataFrame([("X", day("2020-01-03"), "m1", 1.0, 5.0, 25.0)], "security string, date date, manual_action_id string, manual_multiplier double, manual_cash double, distributed_value double")
    last = panel.total_returns(p, none, cash, manual).orderBy("date").collect()[-1]
    assert last.total_return == pytest.approx(0.0) and last.quality_flag == "manual_corporate_action"


def test_segments_map_one_row_to_several_and_reject_repeats(spark):
    seg = spark.createDataFrame([("NEW", "X", day("2020-01-03"), day("2020-12-31")), ("NEW", "Y", day("2020-01-06"), day("2020-12-31"))], "ticker string, security string, start date, end date")
    mapped = panel.map_segments(prices(spark).drop("security"), seg)
    assert sorted((r.security, r.date.day) for r in mapped.collect()) == [("X", 3), ("X", 6), ("Y", 6)]
    with pytest.raises(quality.ConstraintError):
        panel.map_segments(prices(spark).drop("security"), seg.unionByName(seg))


def test_halt_carries_the_close_and_cash_is_carried(spark):
    days = spark.createDataFrame([(day(f"2020-01-0{i}"),) for i in (2, 3, 6)], "date date")
    securities = spark.createDataFrame([("X", day("2020-01-01"), None, None, None)], "security string, listing date, terminal date, cash_start date, remove date")
    halts = spark.createDataFrame([("X", day("2020-01-03"))], "security string, date date")
    grid = panel.lifecycle_grid(prices(spark).where("day(date) <> 3"), days, securities, halts).orderBy("date").collect()
    assert [(r.status, r.close, r.volume) for r in grid] == [("observed", 100.0, 5), ("verified_halt", 100.0, 0), ("observed", 49.0, 5)]
    rows = spark.createDataFrame([("T", day("2020-05-08"), 0.01), ("T", day("2020-05-11"), None), ("T", day("2021-01-04"), None)], "security string, date date, simple_return double")
    exits = spark.createDataFrame([("T", day("2020-05-11"), day("2021-01-01"))], "security string, cash_start date, remove date")
    assert [r.simple_return for r in panel.carry_cash(rows, exits).orderBy("date").collect()] == [0.01, 0.0, None]


def test_balanced_groups_drift_and_reset(spark):
    dates = [day("2020-01-02"), day("2020-01-03"), day("2021-01-04")]
    data = {"A": (0.10, -0.05, 0.02), "B": (0.0, 0.02, 0.01), "C": (0.0, 0.04, -0.03)}
    rows = spark.createDataFrame([(s, d, r) for s, own in data.items() for d, r in zip(dates, own)], "security string, date date, simple_return double")
    labels = spark.createDataFrame([("A", "large"), ("B", "large"), ("C", "singleton")], "security string, group_id string")
    weights = {(r.date, r.group_id): r.group_weight for r in portfolio.balanced_groups(rows, labels).collect()}
    assert weights[dates[0], "large"] == 0.5 and weights[dates[2], "large"] == pytest.approx(0.5)
    assert weights[dates[1], "large"] == pytest.approx((0.25 * 1.10 + 0.25) / 1.025)
    held = portfolio.buy_and_hold(rows, portfolio.equal_group_weights(labels).select("security", "initial_weight"))
    assert portfolio.portfolio_of(held).orderBy("date").first().simple_return == pytest.approx(0.025)
    assert all(r.law_error is None or r.law_error < 1e-12 for r in portfolio.drift_errors(held).collect())


def test_var_and_es_of_one_to_ten():
    assert risk.empirical_var_es([float(x) for x in range(1, 11)], (0.75,), 0.75) == [8.0, pytest.approx(9.2)]
    assert copula.var_es(np.arange(1.0, 11.0), (0.75,), 0.75) == ([8.0], pytest.approx(9.2))


def test_pinball(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "l double, v double").select(pinball(F.col("l"), F.col("v"), 0.95).alias("x")).collect()
    assert [r.x for r in rows] == [pytest.approx(0.05), pytest.approx(0.95)]


def test_rolling_window_leaves_out_its_date(spark):
    start = day("2017-01-02")
    rows = [("m", start + dt.timedelta(i), math.sin(i)) for i in range(60)]
    found = risk.rolling_forecasts(spark.createDataFrame(rows, "model_id string, date date, loss double"), least=50).orderBy("date").collect()
    assert len(found) == 10 and found[0].observations == 50
    (v95, _, _), es = copula.var_es(np.array([x for _, _, x in rows[:50]]), (0.95, 0.975, 0.99), 0.975)
    assert found[0].var_95 == pytest.approx(v95) and found[0].es_975 == pytest.approx(es)


def test_transitions_and_adjustments(spark):
    hits = spark.createDataFrame([("m", 0.75, day(f"2020-01-0{i + 1}"), h) for i, h in enumerate((0, 0, 1, 0))], "model_id string, level double, date date, hit int")
    t = inference.transitions(hits).first()
    assert (t.n00, t.n01, t.n10, t.n11) == (1, 1, 1, 0)
    assert inference.unconditional_coverage(hits).first().lr_uc == pytest.approx(0.0)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    rows = inference.benjamini_hochberg(inference.holm(p, "p", ["name"]), "p", ["name"]).orderBy("name").collect()
    assert [r.p_holm for r in rows] == [pytest.approx(x) for x in (0.03, 0.06, 0.06)]
    assert [r.p_bh for r in rows] == [pytest.approx(x) for x in (0.03, 0.04, 0.04)]


def test_special_functions():
    x = np.linspace(-6, 6, 49)
    assert np.allclose(special.ndtr(special.ndtri(special.ndtr(x))), special.ndtr(x), atol=1e-14)
    assert special.ndtri(np.array([0.975]))[0] == pytest.approx(1.959963984540054, abs=1e-12)
    assert special.t_cdf(np.array([2.0]), 5.0)[0] == pytest.approx(0.9490302605850709, abs=1e-12)
    assert np.allclose(special.t_cdf(special.t_ppf(np.array([0.001, 0.2, 0.5, 0.99]), 3.3), 3.3), [0.001, 0.2, 0.5, 0.99], atol=1e-12)


def test_clusters_of_near_duplicate_pairs():
    names = list("ABCDEF")
    c = np.full((6, 6), 0.1)
    for i, x in zip((0, 2, 4), (0.95, 0.94, 0.93)):
        c[i, i + 1] = c[i + 1, i] = x
    np.fill_diagonal(c, 1.0)
    want = ["cluster_01"] * 2 + ["cluster_02"] * 2 + ["cluster_03"] * 2
    assert cluster.average_linkage(names, np.sqrt((1 - c) / 2), 3)[0] == want
    for rows in (cluster.spectral_embedding(c, 3), cluster.profile_embedding(c)):
        assert cluster.canonical_labels(names, cluster.k_means(rows, 3, (5110, 2020, 1), starts=20)[0]) == want


def test_margin_recovers_a_simulated_series():
    rng = np.random.default_rng(0)
    r, h, x = [], 1.0, 0.0
    for _ in range(1500):
        e = math.sqrt(h) * rng.standard_t(8) * math.sqrt(6 / 8)
        x = 0.05 + 0.1 * x + e
        h = 0.05 + 0.08 * e * e + 0.87 * h
        r.append(x / 100)
    margin, attempts = margins.select_margin(np.array(r))
    assert margin.method == "ar_garch_t" and 0.85 < margin.alpha + margin.beta < 0.999 and not attempts[-1][1]
    u = margins.transform(margin, margins.residuals(margin, np.array(r)), np.zeros(1))
    assert abs(u.mean() - 0.5) < 0.03 and abs(u.var() - 1 / 12) < 0.01
    flat = margins.ewma(np.array(r) * 100)
    assert flat.df is None and flat.next_variance > 0


def test_copula_repair_and_dependence():
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    fixed, changed = copula.repaired(bad)
    assert changed and np.linalg.eigvalsh(fixed).min() > 0 and np.allclose(np.diag(fixed), 1)
    target = np.array([[1, 0.7], [0.7, 1]])
    u = copula.dependent_uniforms(copula.common_uniforms(2020, 1, 40000, 2), target)
    assert copula.fit_correlation(u)[0][0, 1] == pytest.approx(0.7, abs=0.02)


def test_sessions(spark):
    assert calendar.easter(2024) == day("2024-03-31") and calendar.easter(2019) == day("2019-04-21") and calendar.easter(1981) == day("1981-04-19")
    closed = calendar.holidays(2024)
    assert {day("2024-01-01"), day("2024-01-15"), day("2024-02-19"), day("2024-03-29"), day("2024-05-27"), day("2024-06-19"), day("2024-07-04"), day("2024-09-02"), day("2024-11-28"), day("2024-12-25")} == closed
    assert calendar.sessions(spark, day("2017-01-03"), day("2017-12-31")).count() == 251


def test_constraints(spark):
    f = spark.createDataFrame([(0.1, 0.2, 0.3, 0.25, 0.0), (0.3, 0.2, 0.3, 0.25, 0.0), (0.1, 0.2, 0.3, 0.1, 0.0)], "var_95 double, var_975 double, var_99 double, es_975 double, realised_loss double")
    assert quality.forecast_issues(f).count() == 2
    with pytest.raises(quality.ConstraintError):
        quality.require_columns(f, ["var_95"], "f")


def test_monthly_starts_at_the_first_month_with_enough_days(spark):
    import numpy as np
    import pandas as pd

    from riskloom.operators import margins
    from riskloom.plans import modelling

    days = pd.bdate_range("1995-01-02", "1998-03-31")
    r = np.random.default_rng(1).standard_t(6, len(days)) * 0.01
    table = spark.createDataFrame(pd.DataFrame({"group_id": "g", "date": days.date, "log_return": r}))
    expected = sorted({d.strftime("%Y-%m") for d in days if ((days < days[days.to_period("M") == d.to_period("M")].min()) & (days >= days[days.to_period("M") == d.to_period("M")].min() - pd.DateOffset(years=3))).sum() >= 700})
    series, modelling._series = modelling._series, lambda s, d: table
    try:
        months = [x.refit_date.strftime("%Y-%m") for x in modelling.margin_refits(spark, "").orderBy("refit_date").collect()]
        daily = modelling.margin_daily(spark, "").toPandas()
    finally:
        modelling._series = series
    assert months == expected and len(months) > 3
    assert len(daily) == sum(d.strftime("%Y-%m") in expected for d in days)


def test_copula_forecasts_use_training_days_and_empirical_margins(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from riskloom.operators import copula, margins
    from riskloom.plans import modelling

    days = pd.bdate_range("1997-01-02", "2000-01-31")
    rng = np.random.default_rng(2)
    common = rng.standard_normal(len(days))
    r = {g: 0.01 * (0.8 * common + 0.6 * rng.standard_normal(len(days))) for g in "abcde"}
    rows = pd.concat([pd.DataFrame({"group_id": g, "date": days.date, "log_return": x}) for g, x in r.items()])
    table = spark.createDataFrame(rows)

    def fits(x):  # group a, known by its first value, falls back to smoothed variance
        x = np.asarray(x) * margins.SCALE
        if np.isin(x[0], r["a"] * margins.SCALE):
            return margins.ewma(x), []
        return margins.Margin("garch_t", 2, 0.0, 0.0, 0.05, 0.05, 0.9, 8.0, 1.0, float(x[-1]), 0.0), []

    caught = []  # the grouped function runs here, where the fits are replaced
    with monkeypatch.context() as patch:
        patch.setattr(margins, "select_margin", fits)

        def by_group_and_month(self, f, schema):
            at, parts = pd.to_datetime(rows["date"]), []
            for month in sorted(set(at.dt.to_period("M"))):
                near = rows[(at >= month.start_time - pd.DateOffset(years=3)) & (at <= month.end_time)]
                parts += [f((g, month.start_time.date()), x) for g, x in near.groupby("group_id")]
            caught.append(pd.concat([p for p in parts if len(p)]))

        patch.setattr("pyspark.sql.GroupedData.applyInPandas", by_group_and_month)
        margins.monthly(table, out="all")
    every = caught[0].astype(object).where(caught[0].notna(), None)
    fitted = spark.createDataFrame(every.to_dict("records"), margins.ALL)
    monkeypatch.setattr(modelling, "_series", lambda s, d: table)
    monkeypatch.setattr(margins, "monthly", lambda *a, **k: fitted)
    found = modelling.gaussian_copula_forecasts(spark, "").toPandas().sort_values("date", ignore_index=True)
    daily, train = (caught[0][caught[0].kind == k] for k in ("daily", "training"))
    assert (train.date < train.refit_date).all() and set(found.date) == set(daily.date)
    month = found.date.map(lambda x: (x.year, x.month)) == (2000, 1)
    own = train[train.refit_date.map(lambda x: (x.year, x.month)) == (2000, 1)]
    wide = own.pivot(index="date", columns="group_id", values="pit").dropna()
    assert len(wide) >= 700
    correlation, _ = copula.fit_correlation(wide.to_numpy(float))
    u = copula.dependent_uniforms(copula.common_uniforms(2000, 1, copula.DRAWS, 5), correlation)
    z = np.column_stack([copula.innovations(u[:, i], None if g == "a" else 8.0, own[own.group_id == g].residual.to_numpy(float)) for i, g in enumerate("abcde")])
    day = daily[daily.date == found[month].date.iloc[0]].sort_values("group_id")
    losses = -np.expm1(day["mean"].to_numpy(float) + z * day["volatility"].to_numpy(float)) @ np.full(5, 0.2)
    (_, _, v99), es = copula.var_es(losses, (0.95, 0.975, 0.99), 0.975)
    assert np.isclose(found[month].var_99.iloc[0], v99) and np.isclose(found[month].es_975.iloc[0], es)


def test_gap_bootstrap_has_the_protocols_replications(spark, monkeypatch):
    from riskloom.operators import bootstrap
    from riskloom.plans import modelling, protocol

    monkeypatch.setattr(bootstrap, "paired_gap_bootstrap", lambda panel, labels, replications, length: (panel, labels, replications))
    panel, labels, replications = modelling.gap_bootstrap(spark, "/root/testdata/sf0.01")
    assert replications == protocol.FROZEN["inference"]["replications"] == 10_000
    counts = panel.groupBy("year").agg({"date": "max"}).count()
    assert counts > 0 and panel.count() == panel.join(labels, ["year", "security"]).count()


def test_retry_starts_from_a_regression():
    from riskloom.operators import margins

    rng = np.random.default_rng(8)
    r = np.zeros(3000)
    for t in range(1, 3000):
        r[t] = 0.1 + 0.4 * r[t - 1] + rng.standard_normal()
    constant, phi = margins.regression_start(r)
    assert constant == pytest.approx(0.1, abs=0.05) and phi == pytest.approx(0.4, abs=0.05)
    c, phi_, omega, alpha, beta, df = margins._unpack(margins._start(r, True, True), True)
    assert (c, phi_, alpha, beta, df) == pytest.approx((constant, phi, 0.05, 0.9, 8.0)) and omega == pytest.approx(0.05 * np.var(r))
    assert margins.regression_start(np.arange(50.0) ** 3)[1] == 0.95
    margin, reasons = margins.fit_garch(r[:900], True, 3000, True)
    assert margin.phi == pytest.approx(0.4, abs=0.1) and reasons == []
