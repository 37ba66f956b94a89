"""Queries of annual groupings over the nations' monthly returns, with their DuckDB SQL.

The step works on nations that have a return in every month; groups stand in for clusters where SQL has to tell the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drivers, scenario
from ..operators import groupings as gr
from ..operators import panel
from ..sources import views as v
from .oracles import NATIONS

YEARS = (1998, 2001)


def _panel(s, d):
    """Returns, zero where a nation has none, so that every window is complete."""
    rows = v.nation_returns(s, d)
    grid = rows.select("security").distinct().crossJoin(rows.select("date").distinct())
    return grid.join(rows, ["security", "date"], "left").withColumn("simple_return", F.coalesce("simple_return", F.lit(0.0)))


def _schedule(s, d):
    rows = panel.active_schedule(v.nation_returns(s, d).select("security").distinct(), v.nation_calendar(s, d), v.nation_exits(s, d))
    return rows.where(F.col("year").between(*YEARS))


def _other_labels(s, d):
    """Four groups by key, moved by one from year to year for every third nation."""
    key = F.col("n_nationkey")
    rows = v.table(s, d, "nation").select(F.col("n_name").alias("security"), key, F.explode(F.sequence(F.lit(YEARS[0]), F.lit(YEARS[1]))).alias("year"))
    return rows.select("year", "security", F.concat(F.lit("g"), ((key + F.when(key % 3 == 0, F.col("year")).otherwise(0)) % 4).cast("string")).alias("group_id"))


def annual_windows(s, d):
    rows = gr.windows(v.nation_returns(s, d), _schedule(s, d))
    return rows.groupBy("year", "role", "security").agg(F.count("simple_return").alias("days"), F.round(F.sum("simple_return"), 8).alias("total"))


def annual_training_days(s, d):
    schedule = _schedule(s, d)
    return gr.complete_training(gr.windows(v.nation_returns(s, d), schedule), schedule).groupBy("year").agg(F.countDistinct("date").alias("days"), F.count("*").alias("cells"))


def _correlations(s, d):
    return gr.annual_correlations(gr.windows(_panel(s, d), _schedule(s, d)))


def annual_correlations(s, d):
    return _correlations(s, d).withColumn("spearman", F.round(F.col("spearman") + 1.3e-9, 6))


def annual_gaps(s, d):
    found = gr.gaps(_correlations(s, d).where("role = 'evaluation'"), _other_labels(s, d), "year")
    return found.withColumns({c: F.round(F.col(c) + 1.3e-9, 6) for c in ("within_mean", "between_mean", "balanced_gap", "gap")})


def annual_agreement(s, d):
    rows = _schedule(s, d).select("year", "security").join(v.nation_labels(s, d), "security").join(_other_labels(s, d).withColumnRenamed("group_id", "other"), ["year", "security"])
    return gr.agreement(rows, "group_id", "other", "year").withColumns({"ari": F.round("ari", 6), "nmi": F.round("nmi", 6)})


def consecutive_agreement(s, d):
    return gr.consecutive_agreement(_other_labels(s, d)).withColumns({"ari": F.round("ari", 6), "nmi": F.round("nmi", 6)})


def annual_group_returns(s, d):
    labels = _schedule(s, d).select("year", "security").join(v.nation_labels(s, d), "security")
    rows = gr.annual_group_returns(gr.windows(v.nation_returns(s, d), _schedule(s, d)), labels)
    return rows.withColumns({c: F.round(c, 8) for c in ("simple_return", "portfolio_weight", "log_return")})


def annual_cluster_sizes(s, d):
    return gr.cluster_sizes(_other_labels(s, d), "year")


def one_per_issuer(s, d):
    issuers = v.table(s, d, "nation").select(F.col("n_name").alias("security"), F.concat(F.lit("i"), (F.col("n_nationkey") % 7).cast("string")).alias("issuer"))
    return gr.one_per_issuer(_schedule(s, d), issuers)


def hierarchical_groupings(s, d):
    """The whole yearly step: hierarchical groups beside the given ones, without an oracle for the clusters themselves."""
    return gr.annual_groupings(_panel(s, d), _schedule(s, d), v.nation_labels(s, d), least=12)["assignments"]


def ml_groupings(s, d):
    panel_, schedule, labels = _panel(s, d), _schedule(s, d), v.nation_labels(s, d)
    hierarchical = schedule.select("year", "security").join(labels, "security")
    return gr.ml_groupings(panel_, schedule, labels, hierarchical, least=12)["assignments"]


def ml_diagnostics(s, d):
    panel_, schedule, labels = _panel(s, d), _schedule(s, d), v.nation_labels(s, d)
    hierarchical = schedule.select("year", "security").join(labels, "security")
    return gr.ml_groupings(panel_, schedule, labels, hierarchical, least=12)["diagnostics"]


_RISK = ("var_95", "var_975", "var_99", "es_975", "realised_simple_return", "realised_loss")


def _forecasts(rows):
    kept = rows.select("date", "model_id", "grouping_id", "refit_id", *_RISK, "margin_fallback_count", "whole_vine_fallback", "forecast_status")
    return kept.withColumns({c: F.round(F.col(c) + 1.3e-10, 8) for c in _RISK})


def historical_forecasts(s, d):
    """Monthly: windows of at least 24 returns."""
    return _forecasts(drivers.historical_simulation(_panel(s, d), _schedule(s, d), YEARS, 24)[0])


def composition_forecasts(s, d):
    return _forecasts(drivers.current_composition(_panel(s, d), _schedule(s, d), YEARS, 24)[0])


def composition_windows(s, d):
    return drivers.current_composition(_panel(s, d), _schedule(s, d), YEARS, 24)[1].drop("refit_id")


def _assignments(s, d):
    given = _schedule(s, d).select("year", "security").join(v.nation_labels(s, d), "security").withColumn("grouping_id", F.lit("gics"))
    other = _schedule(s, d).select("year", "security").join(_other_labels(s, d), ["year", "security"]).withColumn("grouping_id", F.lit("other"))
    return given.unionByName(other).select("year", "grouping_id", "security", "group_id")


def balanced_group_outputs(s, d):
    groups, _ = drivers.balanced_outputs(_panel(s, d), _schedule(s, d), _assignments(s, d))
    return groups.withColumns({c: F.round(F.col(c) + 1.3e-10, 8) for c in ("group_weight", "group_return")})


def balanced_portfolio_outputs(s, d):
    _, rows = drivers.balanced_outputs(_panel(s, d), _schedule(s, d), _assignments(s, d))
    return rows.withColumns({c: F.round(F.col(c) + 1.3e-10, 8) for c in ("simple_return", "weight_sum")})


def balanced_forecasts(s, d):
    return _forecasts(drivers.balanced_simulation(_panel(s, d), _schedule(s, d), _assignments(s, d), {"gics": "B_GICS_HS", "other": "B_HIER_HS"}, 24)[0])


def _shocked(s, d):
    """One nation's return of 2000-03-01 under two scenarios, in both groupings' returns of that year."""
    labels = _assignments(s, d)
    rows = gr.annual_group_returns(gr.windows(_panel(s, d), _schedule(s, d)), labels, "grouping_id").where("year = 2000 and role = 'evaluation'")
    return rows, labels, scenario.scenario_groups(rows, labels, _panel(s, d), "NATION_1", "2000-03-01", {"zero": -0.2, "cap": 0.3})


def scenario_group_returns(s, d):
    rows = _shocked(s, d)[2]
    return rows.withColumns({c: F.round(F.col(c) + 1.3e-10, 8) for c in ("simple_return", "log_return")})


def scenario_identity(s, d):
    rows, _, shocked = _shocked(s, d)
    old = _panel(s, d).where("security = 'NATION_1' and date = '2000-03-01'").select("simple_return")
    scenarios = s.createDataFrame([("zero", -0.2), ("cap", 0.3)], "scenario_id string, new double")
    change = scenarios.join(old).select("scenario_id", (F.col("new") - F.col("simple_return")).alias("change"))
    found = scenario.portfolio_identity(shocked, rows, "2000-03-01", change)
    return found.withColumns({c: F.round(c, 9) for c in ("event_error", "other_error")})


def queries() -> dict:
    return {f.__name__: f for f in (
        annual_windows, annual_training_days, annual_correlations, annual_gaps, annual_agreement, consecutive_agreement, annual_group_returns, annual_cluster_sizes, one_per_issuer,
        hierarchical_groupings, ml_groupings, ml_diagnostics, historical_forecasts, composition_forecasts, composition_windows, balanced_group_outputs, balanced_portfolio_outputs, balanced_forecasts,
        scenario_group_returns, scenario_identity,
    )}


_YEARLY = NATIONS + f""",
sets AS (SELECT y.year, y.rebalance_date, s.security FROM (SELECT CAST(year(date) AS INTEGER) AS year, min(date) AS rebalance_date FROM panel GROUP BY 1) y CROSS JOIN (SELECT DISTINCT security FROM panel) s
         LEFT JOIN nation ON n_name = s.security WHERE (n_nationkey % 5 <> 4 OR y.rebalance_date < DATE '1999-07-01') AND y.year BETWEEN {YEARS[0]} AND {YEARS[1]}),
win AS (SELECT s.year, CASE WHEN p.date < s.rebalance_date THEN 'training' ELSE 'evaluation' END AS role, s.security, p.date, p.r FROM sets s JOIN panel p ON p.security = s.security
        AND ((p.date >= s.rebalance_date - INTERVAL 3 YEAR AND p.date < s.rebalance_date) OR (p.date >= s.rebalance_date AND year(p.date) = s.year))),
other AS (SELECT y AS year, n_name AS security, 'g' || ((n_nationkey + CASE WHEN n_nationkey % 3 = 0 THEN y ELSE 0 END) % 4) AS group_id FROM nation CROSS JOIN (SELECT unnest(range({YEARS[0]}, {YEARS[1] + 1})) AS y))"""
_YEAR_PAIRS = _YEARLY + f""",
full_panel AS (SELECT s.security, c.date, coalesce(p.r, 0) AS r FROM (SELECT DISTINCT security FROM panel) s CROSS JOIN (SELECT DISTINCT date FROM panel) c LEFT JOIN panel p ON p.security = s.security AND p.date = c.date),
full_win AS (SELECT s.year, CASE WHEN p.date < s.rebalance_date THEN 'training' ELSE 'evaluation' END AS role, s.security, p.date, p.r FROM sets s JOIN full_panel p ON p.security = s.security
        AND ((p.date >= s.rebalance_date - INTERVAL 3 YEAR AND p.date < s.rebalance_date) OR (p.date >= s.rebalance_date AND year(p.date) = s.year))),
shared AS (SELECT a.year, a.role, a.security AS a, b.security AS b, a.r AS x, b.r AS y FROM full_win a JOIN full_win b ON a.year = b.year AND a.role = b.role AND a.date = b.date AND a.security < b.security),
rk AS (SELECT year, role, a, b, rank() OVER (PARTITION BY year, role, a, b ORDER BY x) + (count(*) OVER (PARTITION BY year, role, a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY year, role, a, b ORDER BY y) + (count(*) OVER (PARTITION BY year, role, a, b, y) - 1) / 2.0 AS ry FROM shared),
corrs AS (SELECT year, role, a, b, count(*) AS n, corr(rx, ry) AS spearman FROM rk GROUP BY ALL)"""


def _agreement(cells: str, by: str, n: str) -> str:
    """ARI and NMI from a table of (by, l, r) rows."""
    return f"""c AS (SELECT {by}, l, r, CAST(count(*) AS DOUBLE) AS n FROM {cells} GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY {by}, l) AS nl, sum(n) OVER (PARTITION BY {by}, r) AS nr, sum(n) OVER (PARTITION BY {by}) AS t FROM c),
        k AS (SELECT {by}, any_value(t) AS t, sum(n * (n - 1) / 2) AS same, sum(nl * (nl - 1) / 2 * n / nl) AS sl, sum(nr * (nr - 1) / 2 * n / nr) AS sr, sum(n / t * ln(n * t / (nl * nr))) AS mi, sum(-n / t * ln(nl / t)) AS hl, sum(-n / t * ln(nr / t)) AS hr FROM w GROUP BY ALL)
        SELECT {by}, CAST(t AS BIGINT) AS {n}, round((same - sl * sr / (t * (t - 1) / 2)) / ((sl + sr) / 2 - sl * sr / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((hl + hr) / 2), 6) AS nmi FROM k"""


_FILLED = _YEAR_PAIRS[: _YEAR_PAIRS.index(",\nshared AS")]
_BOOK = _FILLED + """,
assigned AS (SELECT s.year, 'gics' AS grouping_id, s.security, l.group_id FROM sets s JOIN labels l USING (security) UNION ALL SELECT s.year, 'other', s.security, o.group_id FROM sets s JOIN other o ON o.year = s.year AND o.security = s.security),
members AS (SELECT year, grouping_id, group_id, count(*) AS members FROM assigned GROUP BY ALL), started AS (SELECT a.*, 1.0 / (m.members * (SELECT count(*) FROM members k WHERE k.year = a.year AND k.grouping_id = a.grouping_id)) AS w0 FROM assigned a JOIN members m ON m.year = a.year AND m.grouping_id = a.grouping_id AND m.group_id = a.group_id),
grown AS (SELECT a.grouping_id, w.year, w.role, w.date, a.group_id, w.r, a.w0 * exp(coalesce(sum(ln(1 + w.r)) OVER (PARTITION BY a.grouping_id, w.year, w.security, year(w.date) ORDER BY w.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS wealth FROM full_win w JOIN started a ON a.year = w.year AND a.security = w.security),
held AS (SELECT *, wealth / sum(wealth) OVER (PARTITION BY grouping_id, year, date) AS weight FROM grown)"""


def _rolled(source: str, model: str) -> str:
    """Forecasts of a table ``source`` (k, date, loss), one window series for each k, least 24."""
    order = lambda c: f"max(CASE WHEN i = ceil(CAST(n AS DOUBLE) * CAST({c} AS DOUBLE)) THEN x END)"
    c = "CAST(n AS DOUBLE) * CAST(0.975 AS DOUBLE)"
    return f"""pairs_ AS (SELECT t.k, t.date, t.loss AS realised_loss, w.loss AS x, row_number() OVER (PARTITION BY t.k, t.date ORDER BY w.loss) AS i, count(*) OVER (PARTITION BY t.k, t.date) AS n, w.date AS wd
            FROM {source} t JOIN {source} w ON w.k = t.k AND w.date >= t.date - INTERVAL 3 YEAR AND w.date < t.date),
        rolled AS (SELECT k, date, any_value(n) AS n, max(wd) AS training_end, {order(0.95)} AS var_95, {order(0.975)} AS var_975, {order(0.99)} AS var_99,
            (sum(CASE WHEN i > ceil({c}) THEN x ELSE 0 END) + max(CASE WHEN i = ceil({c}) THEN x * (i - {c}) END)) / (any_value(CAST(n AS DOUBLE)) * (1 - CAST(0.975 AS DOUBLE))) AS es_975, any_value(realised_loss) AS realised_loss FROM pairs_ WHERE n >= 24 GROUP BY 1, 2)"""


def _record(model: str, refit: str, where: str) -> str:
    risk = ", ".join(f"round({c} + 1.3e-10, 8) AS {c}" for c in ("var_95", "var_975", "var_99", "es_975", "realised_loss"))
    return f"""SELECT date, {model} AS model_id, 'none' AS grouping_id, {refit} || ':' || date AS refit_id, {risk}, round(-realised_loss + 1.3e-10, 8) AS realised_simple_return, 0 AS margin_fallback_count, false AS whole_vine_fallback, 'ok' AS forecast_status FROM rolled WHERE {where}"""


def _more() -> dict[str, str]:
    low, high = YEARS
    m0 = f"""{_FILLED}, book AS (SELECT 'M0' AS k, p.date, -avg(p.r) AS loss FROM full_panel p JOIN sets s ON s.security = p.security AND s.year = greatest(year(p.date), {low}) GROUP BY 2)"""
    cc = f"""{_FILLED}, book AS (SELECT 'M0_CC|' || s.year AS k, p.date, -avg(p.r) AS loss FROM full_panel p JOIN sets s ON s.security = p.security AND p.date >= s.rebalance_date - INTERVAL 3 YEAR AND year(p.date) <= s.year GROUP BY 1, 2)"""
    balanced = f"""{_BOOK}, book AS (SELECT CASE grouping_id WHEN 'gics' THEN 'B_GICS_HS|' ELSE 'B_HIER_HS|' END || year AS k, date, -sum(weight * r) AS loss FROM held GROUP BY 1, 2)"""
    own = "year(date) = CAST(split_part(k, '|', 2) AS INTEGER)"
    shock = f"""{_BOOK}, sc(scenario_id, new) AS (VALUES ('zero', CAST(-0.2 AS DOUBLE)), ('cap', CAST(0.3 AS DOUBLE))),
        cells AS (SELECT sc.scenario_id, a.grouping_id, w.date, a.group_id, CASE WHEN w.security = 'NATION_1' AND w.date = DATE '2000-03-01' THEN sc.new ELSE w.r END AS r FROM full_win w JOIN assigned a ON a.year = w.year AND a.security = w.security CROSS JOIN sc WHERE w.year = 2000 AND w.role = 'evaluation')"""
    return {
        "historical_forecasts": f"WITH {m0}, {_rolled('book', 'M0')} {_record('k', 'k', f'year(date) BETWEEN {low} AND {high}')}",
        "composition_forecasts": f"WITH {cc}, {_rolled('book', 'M0_CC')} {_record('split_part(k, ' + chr(39) + '|' + chr(39) + ', 1)', 'k', own)}",
        "composition_windows": f"""WITH {cc}, {_rolled('book', 'M0_CC')} SELECT split_part(k, '|', 1) AS model_id, date AS forecast_date, CAST(date - INTERVAL 3 YEAR AS DATE) AS window_start, training_end, CAST(n AS INTEGER) AS training_observations FROM rolled WHERE {own}""",
        "balanced_group_outputs": f"WITH {_BOOK} SELECT grouping_id, year, role, date, group_id, round(sum(weight) + 1.3e-10, 8) AS group_weight, round(sum(weight * r) / sum(weight) + 1.3e-10, 8) AS group_return FROM held GROUP BY ALL",
        "balanced_portfolio_outputs": f"WITH {_BOOK} SELECT grouping_id, year, role, date, round(sum(weight * r) + 1.3e-10, 8) AS simple_return, round(sum(weight) + 1.3e-10, 8) AS weight_sum FROM held GROUP BY ALL",
        "balanced_forecasts": f"WITH {balanced}, {_rolled('book', 'B')} {_record('split_part(k, ' + chr(39) + '|' + chr(39) + ', 1)', 'k', own)}",
        "scenario_group_returns": f"WITH {shock} SELECT scenario_id, grouping_id, date, group_id, round(avg(r) + 1.3e-10, 8) AS simple_return, round(ln(1 + avg(r)) + 1.3e-10, 8) AS log_return, count(*) AS group_size FROM cells GROUP BY 1, 2, 3, 4",
        "scenario_identity": f"WITH {shock} SELECT DISTINCT scenario_id, grouping_id, CAST(0 AS DOUBLE) AS event_error, CAST(0 AS DOUBLE) AS other_error, 'pass' AS status FROM cells",
    }


def oracle_sql() -> dict[str, str]:
    return _more() | {
        "annual_windows": f"WITH {_YEARLY} SELECT year, role, security, count(r) AS days, round(sum(r), 8) AS total FROM win GROUP BY ALL",
        "annual_training_days": f"""WITH {_YEARLY}, k AS (SELECT year, count(*) AS active FROM sets GROUP BY 1), x AS (SELECT year, date, count(*) AS n FROM win WHERE role = 'training' GROUP BY 1, 2)
            SELECT x.year, count(*) AS days, CAST(sum(n) AS BIGINT) AS cells FROM x JOIN k USING (year) WHERE n = active GROUP BY 1""",
        "annual_correlations": f"WITH {_YEAR_PAIRS} SELECT year, role, a, b, n, round(spearman + 1.3e-9, 6) AS spearman FROM corrs",
        "annual_gaps": f"""WITH {_YEAR_PAIRS}, g AS (SELECT c.year, spearman, x.group_id = y.group_id AS within, least(x.group_id, y.group_id) AS g, greatest(x.group_id, y.group_id) AS h FROM corrs c JOIN other x ON x.year = c.year AND x.security = a JOIN other y ON y.year = c.year AND y.security = b WHERE role = 'evaluation'),
            cell AS (SELECT year, within, g, h, avg(spearman) AS m FROM g GROUP BY ALL), e AS (SELECT year, avg(m) FILTER (WHERE within) - avg(m) FILTER (WHERE NOT within) AS balanced FROM cell GROUP BY 1)
            SELECT g.year, round(avg(spearman) FILTER (WHERE within) + 1.3e-9, 6) AS within_mean, round(avg(spearman) FILTER (WHERE NOT within) + 1.3e-9, 6) AS between_mean, round(any_value(balanced) + 1.3e-9, 6) AS balanced_gap,
                   count(*) FILTER (WHERE within) AS within_pairs, count(*) FILTER (WHERE NOT within) AS between_pairs, round(avg(spearman) FILTER (WHERE within) - avg(spearman) FILTER (WHERE NOT within) + 1.3e-9, 6) AS gap FROM g JOIN e ON e.year = g.year GROUP BY 1""",
        "annual_agreement": f"WITH {_YEARLY}, rows_ AS (SELECT s.year, l.group_id AS l, o.group_id AS r FROM sets s JOIN labels l USING (security) JOIN other o ON o.year = s.year AND o.security = s.security), {_agreement('rows_', 'year', 'n')}",
        "consecutive_agreement": f"WITH {_YEARLY}, rows_ AS (SELECT a.year, a.group_id AS l, b.group_id AS r FROM other a JOIN other b ON b.year + 1 = a.year AND b.security = a.security), {_agreement('rows_', 'year', 'common')}",
        "annual_group_returns": f"""WITH {_YEARLY}, k AS (SELECT year, group_id, count(*) AS members FROM sets JOIN labels USING (security) GROUP BY 1, 2), kk AS (SELECT *, sum(members) OVER (PARTITION BY year) AS every FROM k),
            m AS (SELECT w.year, w.role, w.date, l.group_id, avg(r) AS r, count(*) AS n FROM win w JOIN labels l USING (security) GROUP BY ALL)
            SELECT m.year, role, date, m.group_id, round(r, 8) AS simple_return, members AS group_size, round(members / CAST(every AS DOUBLE), 8) AS portfolio_weight, round(ln(1 + r), 8) AS log_return FROM m JOIN kk ON kk.year = m.year AND kk.group_id = m.group_id WHERE n = members""",
        "annual_cluster_sizes": f"WITH {_YEARLY} SELECT year, group_id, count(*) AS members FROM other GROUP BY 1, 2",
        "one_per_issuer": f"WITH {_YEARLY}, x AS (SELECT s.*, row_number() OVER (PARTITION BY year, n_nationkey % 7 ORDER BY security) AS k FROM sets s JOIN nation ON n_name = security) SELECT year, rebalance_date, security FROM x WHERE k = 1",
    }
