"""Whole steps on a small daily panel: forecasts and their audits, drifting portfolios, what-if reruns."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import drivers, evaluation, scenario
from riskloom.operators.quality import ConstraintError

NAMES = list("abcd")


@pytest.fixture(scope="module")
def panel(spark):
    days = pd.bdate_range("2017-01-02", "2020-06-30")
    rng = np.random.default_rng(9)
    rows = pd.concat([pd.DataFrame({"security": n, "date": days.date, "simple_return": 0.01 * rng.standard_normal(len(days))}) for n in NAMES])
    return spark.createDataFrame(rows).cache()


@pytest.fixture(scope="module")
def schedule(spark):
    return spark.createDataFrame([(2020, dt.date(2020, 1, 1), n) for n in NAMES], "year int, rebalance_date date, security string")


@pytest.fixture(scope="module")
def assignments(spark):
    return spark.createDataFrame([(2020, g, n, f"{g}{(k // 2 if g == 'x' else min(k, 1))}") for g in "xy" for k, n in enumerate(NAMES)], "year int, grouping_id string, security string, group_id string")


def test_historical_and_composition_agree_when_the_set_never_changes(panel, schedule):
    (a, wa, audit_a), (b, wb, audit_b) = (f(panel, schedule, (2020, 2020)) for f in (drivers.historical_simulation, drivers.current_composition))
    assert audit_a()["status"] == audit_b()["status"] == "pass" and audit_a()["forecasts"] == 130
    x, y = (r.orderBy("date").toPandas() for r in (a, b))
    assert np.allclose(x[["var_95", "es_975", "realised_loss"]], y[["var_95", "es_975", "realised_loss"]]) and set(y.model_id) == {"M0_CC"}
    assert evaluation.normalised(a, {"M0"}).count() == 130 and evaluation.historical_problems(a).count() == 0
    assert wa.where("training_end >= forecast_date").count() == 0 and wb.count() == 130
    late = drivers.historical_simulation(panel, schedule, (2020, 2020), 10_000)
    assert "incomplete_coverage" in late[2]()["issues"]


def test_drifting_portfolios(panel, schedule, assignments):
    groups, books = drivers.balanced_outputs(panel, schedule, assignments)
    found = drivers.construction_quality(groups, books)
    assert found["status"] == "pass" and found["resets"] == 8  # four calendar years in two groupings
    # against the recursion
    wide = panel.toPandas().pivot(index="date", columns="security", values="simple_return")
    label = {r.security: r.group_id for r in assignments.where("grouping_id = 'y'").collect()}
    sizes = pd.Series(label).value_counts()
    start = np.array([1 / (len(sizes) * sizes[label[n]]) for n in NAMES])
    expected, w, year = {}, start, None
    for day, r in zip(wide.index, wide.to_numpy()):
        w = start if day.year != year else w
        year, total = day.year, float(w @ r)
        expected[day] = total
        w = w * (1 + r) / (1 + total)
    rows = {r.date: r.simple_return for r in books.where("grouping_id = 'y'").collect()}
    assert rows.keys() == expected.keys() and all(rows[d] == pytest.approx(expected[d], abs=1e-14) for d in rows)
    training, evaluated = drivers.annual_samples(groups, "x", 2020)
    assert training.where("date >= '2020-01-01'").count() == 0 and evaluated.count() == 260
    with pytest.raises(ValueError):
        drivers.annual_samples(groups, "x", 2021)
    with pytest.raises(ConstraintError):
        drivers.annual_samples(groups.withColumn("date", F.lit(dt.date(2020, 1, 1))), "x", 2020)
    bad = drivers.construction_quality(groups.withColumn("group_weight", F.col("group_weight") * -1), books.withColumn("weight_sum", F.lit(0.9)).unionByName(books))
    assert bad["issues"] == ["duplicate_portfolio_row", "nonpositive_group_weight", "weights_do_not_sum_to_one", "unequal_groups_at_reset"]
    rows, _, audit = drivers.balanced_simulation(panel, schedule, assignments, {"x": "B1", "y": "B2"})
    assert audit()["status"] == "pass" and {r.model_id for r in rows.select("model_id").distinct().collect()} == {"B1", "B2"}


def test_segments_must_be_whole(panel, schedule, assignments):
    with pytest.raises(ConstraintError):
        drivers.return_segment(panel, schedule, assignments.where("not (grouping_id = 'x' and security = 'a')"))
    with pytest.raises(ConstraintError):
        drivers.return_segment(panel, schedule.where("security <> 'a'"), assignments)
    for value in (None, -1.0, float("inf")):
        hole = panel.withColumn("simple_return", F.when((F.col("security") == "b") & (F.col("date") == "2019-03-01"), F.lit(value).cast("double")).otherwise(F.col("simple_return")))
        with pytest.raises(ConstraintError):
            drivers.return_segment(hole, schedule, assignments)
    assert {tuple(r.members) for r in drivers.memberships(assignments, "grouping_id").collect()} == {("a", "b"), ("c", "d"), ("a",), ("b", "c", "d")}


def test_a_scenario_moves_one_cell_and_is_evaluated_anew(spark, panel, schedule, assignments):
    from riskloom.operators import groupings

    rows = groupings.annual_group_returns(groupings.windows(panel, schedule), assignments, "grouping_id").select("grouping_id", "date", "group_id", "simple_return", "group_size")
    old = panel.where("security = 'a' and date = '2020-03-02'").first().simple_return
    new = scenario.event_return(10.0, 11.0, 0.5)
    assert new == pytest.approx(0.15)
    shocked = scenario.scenario_groups(rows, assignments, panel, "a", "2020-03-02", {"primary": old, "up": new})
    moved = shocked.join(rows.withColumnRenamed("simple_return", "before"), ["grouping_id", "date", "group_id"]).where("abs(simple_return - before) > 1e-15").collect()
    assert {(r.scenario_id, r.grouping_id, str(r.date), r.group_id) for r in moved} == {("up", "x", "2020-03-02", "x0"), ("up", "y", "2020-03-02", "y0")}
    change = spark.createDataFrame([("primary", 0.0), ("up", new - old)], "scenario_id string, change double")
    assert {r.status for r in scenario.portfolio_identity(shocked, rows, "2020-03-02", change).collect()} == {"pass"}
    assert "fail" in {r.status for r in scenario.portfolio_identity(shocked, rows, "2020-03-02", change.withColumn("change", F.lit(1.0))).collect()}
    for call in (lambda: scenario.affected_groups(assignments.unionByName(assignments), "a", 2020), lambda: scenario.affected_groups(assignments, "q", 2020), lambda: scenario.scenario_groups(rows, assignments, panel, "a", "2020-03-01", {"primary": 0.0}), lambda: scenario.event_return(0.0, 1.0, 1.0)):
        with pytest.raises(ValueError):
            call()

    def forecast(groups, models):  # a stand-in for the chain: fixed risks, the realised loss of the grouping
        days = groups.where("date >= '2020-01-01'").groupBy("date").agg((F.sum(F.col("simple_return") * F.col("group_size")) / F.sum("group_size")).alias("r"))
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(x["grouping_id"]).alias("grouping_id"), F.lit(x["v"]).alias("v")) for m, x in models.items()]))
        x = days.select("date", "r", each.alias("m")).withColumn("v", F.col("m.v") + F.dayofmonth("date") / 1e4)
        return x.select(
            "date", "m.model_id", "m.grouping_id", F.concat_ws(":", "m.model_id", "date").alias("refit_id"), F.col("v").alias("var_95"), (F.col("v") * 1.2).alias("var_975"), (F.col("v") * 1.4).alias("var_99"), (F.col("v") * 1.5).alias("es_975"),
            F.col("r").alias("realised_simple_return"), (-F.col("r")).alias("realised_loss"), F.array(F.lit(5110), F.year("date"), F.month("date")).cast("array<bigint>").alias("seed_components"), F.lit(0).alias("margin_fallback_count"),
            F.lit(False).alias("whole_vine_fallback"), F.lit("ok").alias("forecast_status"), F.lit(1.0).alias("copula_log_score"),
        )

    models = {"M1": {"grouping_id": "x", "v": 0.01}, "M2": {"grouping_id": "y", "v": 0.012}}
    family = evaluation.Family("two", {"M1": "x", "M2": "y"}, accuracy_tests=3, tolerance=1e-9)
    out = drivers.scenario_rerun(rows, assignments, panel, "a", "2020-03-02", {"primary": old, "up": new}, models, forecast, family, [("M2", "M1")])
    assert set(out) == {"primary", "up"} and "differences" not in out["primary"]
    differences = {r.model_id: r for r in out["up"]["differences"].collect()}
    assert set(differences) == {"M1", "M2"} and all(r.days == 130 and r.most_quantile_loss_95 > 0 for r in differences.values())
    with pytest.raises(ValueError):
        drivers.scenario_rerun(rows, assignments, panel, "a", "2020-03-02", {"up": new}, models, forecast, family, [])
