"""The registered queries' rows in DuckDB SQL, written apart from the Spark plans."""

from __future__ import annotations

PRICES = """prices AS (
  SELECT r_name AS security, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close, max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low, CAST(sum(l_quantity) AS BIGINT) AS volume,
         CASE WHEN year(CAST(l_shipdate AS DATE)) < 1998 THEN r_name || '_OLD' ELSE r_name || '_NEW' END AS ticker
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name, CAST(l_shipdate AS DATE))"""
RETURNS = PRICES + """,
returns AS (SELECT security, date, close / lag(close) OVER (PARTITION BY security ORDER BY date) - 1 AS r FROM prices)"""
LOSSES = RETURNS + """,
losses AS (SELECT security AS model_id, date, -r / 100 AS loss FROM returns WHERE r IS NOT NULL)"""
FORECASTS = LOSSES + """,
win AS (SELECT t.model_id, t.date, t.loss AS realised_loss, w.loss AS x,
               row_number() OVER (PARTITION BY t.model_id, t.date ORDER BY w.loss) AS k,
               count(*) OVER (PARTITION BY t.model_id, t.date) AS n
        FROM losses t JOIN losses w ON w.model_id = t.model_id AND w.date >= t.date - INTERVAL 3 YEAR AND w.date < t.date),
forecasts AS (
  SELECT model_id, date, CAST(any_value(n) AS INTEGER) AS observations,
         max(CASE WHEN k = ceil(CAST(n AS DOUBLE) * CAST(0.95 AS DOUBLE)) THEN x END) AS var_95,
         max(CASE WHEN k = ceil(CAST(n AS DOUBLE) * CAST(0.975 AS DOUBLE)) THEN x END) AS var_975,
         max(CASE WHEN k = ceil(CAST(n AS DOUBLE) * CAST(0.99 AS DOUBLE)) THEN x END) AS var_99,
         (sum(CASE WHEN k > ceil(CAST(n AS DOUBLE) * CAST(0.975 AS DOUBLE)) THEN x ELSE 0 END)
          + max(CASE WHEN k = ceil(CAST(n AS DOUBLE) * CAST(0.975 AS DOUBLE)) THEN x * (k - CAST(n AS DOUBLE) * CAST(0.975 AS DOUBLE)) END))
         / (any_value(CAST(n AS DOUBLE)) * (1 - CAST(0.975 AS DOUBLE))) AS es_975, any_value(realised_loss) AS realised_loss
  FROM win WHERE n >= 700 GROUP BY model_id, date)"""
SCORES = FORECASTS + """,
scores AS (
  SELECT *, (CAST(0.95 AS DOUBLE) - CASE WHEN realised_loss < var_95 THEN 1 ELSE 0 END) * (realised_loss - var_95) AS quantile_loss_95,
         (CAST(0.99 AS DOUBLE) - CASE WHEN realised_loss < var_99 THEN 1 ELSE 0 END) * (realised_loss - var_99) AS quantile_loss_99,
         CASE WHEN realised_loss > var_975 THEN realised_loss - var_975 ELSE 0 END / ((1 - CAST(0.975 AS DOUBLE)) * es_975) + var_975 / es_975 + ln(es_975) - 1 AS fz0_975,
         realised_loss > var_95 AS exception_95, realised_loss > var_975 AS exception_975, realised_loss > var_99 AS exception_99
  FROM forecasts)"""
SERIES = SCORES + """,
series AS (SELECT model_id, CAST(0.95 AS DOUBLE) AS level, date, CAST(exception_95 AS INTEGER) AS hit FROM scores
           UNION ALL SELECT model_id, CAST(0.99 AS DOUBLE), date, CAST(exception_99 AS INTEGER) FROM scores)"""
MEANS = SCORES + """,
means AS (SELECT model_id, count(*) AS days, avg(quantile_loss_95) AS a, avg(quantile_loss_99) AS b, avg(fz0_975) AS c,
                 CAST(sum(CAST(exception_95 AS INTEGER)) AS BIGINT) AS e95, CAST(sum(CAST(exception_975 AS INTEGER)) AS BIGINT) AS e975, CAST(sum(CAST(exception_99 AS INTEGER)) AS BIGINT) AS e99
          FROM scores GROUP BY model_id),
ranks AS (SELECT *, (rank() OVER (ORDER BY round(a, 12)) + (count(*) OVER (PARTITION BY round(a, 12)) - 1) / 2.0
                    + rank() OVER (ORDER BY round(b, 12)) + (count(*) OVER (PARTITION BY round(b, 12)) - 1) / 2.0
                    + rank() OVER (ORDER BY round(c, 12)) + (count(*) OVER (PARTITION BY round(c, 12)) - 1) / 2.0) / 3.0 AS average_rank FROM means)"""
NATIONS = """months AS (
  SELECT n_name AS security, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS close
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
panel AS (SELECT * FROM (SELECT security, date, (close / lag(close) OVER (PARTITION BY security ORDER BY date) - 1) / 10 AS r FROM months) WHERE r IS NOT NULL),
labels AS (SELECT n_name AS security, r_name AS group_id FROM nation JOIN region ON n_regionkey = r_regionkey)"""
EXITS = NATIONS + """,
exits AS (SELECT n_name AS security, DATE '1998-07-01' AS cash_start, DATE '1999-07-01' AS remove FROM nation WHERE n_nationkey % 5 = 4),
calendar AS (SELECT DISTINCT date FROM panel),
schedule AS (SELECT y.year, y.rebalance_date, s.security FROM (SELECT CAST(year(date) AS INTEGER) AS year, min(date) AS rebalance_date FROM calendar GROUP BY 1) y
             CROSS JOIN (SELECT DISTINCT security FROM panel) s LEFT JOIN exits e ON e.security = s.security WHERE e.remove IS NULL OR y.rebalance_date < e.remove)"""
EVENTS = PRICES + """,
events_all AS (SELECT l_orderkey * 10 + l_linenumber AS event_id, r_name AS security, CAST(l_shipdate AS DATE) AS date, l_linenumber, l_discount, l_returnflag, l_quantity
               FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
splits AS (SELECT event_id, security, date, 1 + l_linenumber / 4.0 AS factor FROM events_all WHERE l_returnflag = 'R' AND l_quantity = 50),
dividends AS (SELECT event_id, security, date, l_discount * 100 + 1 AS amount FROM events_all WHERE l_returnflag = 'A' AND l_quantity = 49),
split_days AS (SELECT security, date, CAST(product(factor) AS DOUBLE) AS split_factor, count(*) AS split_events FROM splits GROUP BY 1, 2),
dividend_days AS (SELECT security, date, sum(amount) AS cash_dividend, count(*) AS dividend_events FROM dividends GROUP BY 1, 2)"""
SEGMENTS = """segments AS (
  SELECT r_name || '_OLD' AS ticker, r_name AS security, DATE '1995-01-01' AS s, DATE '1997-12-31' AS e FROM region
  UNION ALL SELECT r_name || '_NEW', r_name, DATE '1998-01-01', DATE '2001-12-31' FROM region
  UNION ALL SELECT 'AMERICA_NEW', 'SPINOFF', DATE '1999-01-01', DATE '2001-12-31' FROM region WHERE r_name = 'AMERICA')"""
TOTAL = EVENTS + """,
joined AS (SELECT p.security, p.date, p.ticker, p.close, s.split_factor,
                  coalesce(s.split_factor, 1.0) * p.close + coalesce(s.split_factor, 1.0) * coalesce(d.cash_dividend, 0.0) AS consideration,
                  lag(p.close) OVER w AS pc, lag(p.ticker) OVER w AS pt
           FROM prices p LEFT JOIN split_days s ON s.security = p.security AND s.date = p.date
           LEFT JOIN dividend_days d ON d.security = p.security AND d.date = p.date WINDOW w AS (PARTITION BY p.security ORDER BY p.date)),
total AS (SELECT *, CASE WHEN pc > 0 AND close > 0 AND consideration / pc > 0 THEN consideration / pc END AS gross FROM joined),
daily AS (SELECT *, gross - 1 AS total_return, ln(gross) AS log_total_return,
  concat_ws(';', CASE WHEN close <= 0 THEN 'nonpositive_close' END, CASE WHEN ticker <> pt THEN 'ticker_segment_transition' END,
            CASE WHEN abs(gross - 1) > 0.4 THEN 'extreme_total_return' END,
            CASE WHEN abs(close / pc - 1) > 0.4 AND split_factor IS NULL THEN 'extreme_unadjusted_return_without_split' END) AS quality_flag FROM total)"""
GROUPS = NATIONS + """,
groups AS (SELECT date, group_id, avg(r) AS r, count(r) AS n FROM panel JOIN labels USING (security) GROUP BY 1, 2)"""
HELD = NATIONS + """,
init AS (SELECT security, group_id, 1.0 / ((SELECT count(DISTINCT group_id) FROM labels) * count(*) OVER (PARTITION BY group_id)) AS w0 FROM labels),
grown AS (SELECT p.security, p.date, year(p.date) AS period, p.r, i.group_id,
                 i.w0 * exp(coalesce(sum(ln(1 + p.r)) OVER (PARTITION BY p.security, year(p.date) ORDER BY p.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS wealth
          FROM panel p JOIN init i USING (security)),
held AS (SELECT *, wealth / sum(wealth) OVER (PARTITION BY date) AS weight FROM grown)"""
PAIRS = NATIONS + """,
shared AS (SELECT a.security AS a, b.security AS b, a.r AS x, b.r AS y FROM panel a JOIN panel b ON a.date = b.date AND a.security < b.security),
ranked AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx,
                  rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM shared),
pairs AS (SELECT a, b, count(*) AS n, CASE WHEN count(*) >= ceil((SELECT count(DISTINCT date) FROM panel) * 0.8) THEN corr(rx, ry) END AS spearman FROM ranked GROUP BY a, b)"""


def _ari(table: str, left: str, right: str) -> str:
    return f"""WITH cells AS (SELECT {left} AS l, {right} AS r, count(*) AS n FROM {table} GROUP BY 1, 2),
    x AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM cells) AS s, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM cells GROUP BY l)) AS a,
                 (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM cells GROUP BY r)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM cells) AS t)
    SELECT round((s - a * b / t) / ((a + b) / 2 - a * b / t), 6) AS ari FROM x"""


def _nmi(table: str, left: str, right: str) -> str:
    return f"""WITH cells AS (SELECT {left} AS l, {right} AS r, CAST(count(*) AS DOUBLE) AS n FROM {table} GROUP BY 1, 2),
    j AS (SELECT n, sum(n) OVER (PARTITION BY l) AS nl, sum(n) OVER (PARTITION BY r) AS nr, sum(n) OVER () AS t FROM cells)
    SELECT round(sum(n / t * ln(n * t / (nl * nr))) / ((sum(-n / t * ln(nl / t)) + sum(-n / t * ln(nr / t))) / 2), 6) AS nmi FROM j"""


_LL = "(CASE WHEN {x} = 0 THEN 0 ELSE {x} * ln({p}) END + CASE WHEN {n} - {x} = 0 THEN 0 ELSE ({n} - {x}) * ln(1 - {p}) END)"


def _ll(x: str, n: str, p: str) -> str:
    return _LL.format(x=x, n=n, p=p)


_DM = SCORES + """,
d AS (SELECT a.model_id, b.model_id AS baseline_id, a.date, a.fz0_975 - b.fz0_975 AS d FROM scores a JOIN scores b ON a.date = b.date AND a.model_id < b.model_id),
c AS (SELECT *, d - avg(d) OVER (PARTITION BY model_id, baseline_id) AS c FROM d),
l AS (SELECT *, """ + ", ".join(f"lag(c, {k}) OVER (PARTITION BY model_id, baseline_id ORDER BY date) AS c{k}" for k in range(1, 8)) + """ FROM c),
g AS (SELECT model_id, baseline_id, count(*) AS days, avg(d) AS m, (sum(c * c)""" + "".join(f" + 2 * (1 - {k} / 8.0) * coalesce(sum(c * c{k}), 0)" for k in range(1, 8)) + """) / count(*) AS v FROM l GROUP BY 1, 2),
dm AS (SELECT model_id, baseline_id, days, m AS mean_difference, CASE WHEN v > 0 THEN m / sqrt(v / days) END AS dm_statistic FROM g)"""

def erfc(x: str) -> str:
    """The complementary error function by Simpson's rule with 1,000 steps."""
    weight = "CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(1 - 2 / sqrt(pi()) * ({x}) / 3000 * list_sum(list_transform(range(0, 1001), lambda i: {weight} * exp(-pow(({x}) * i / 1000, 2)))))"


def _calibrated() -> str:
    total, p01, p11 = "(n00 + n01 + n10 + n11)", "(CASE WHEN n00 + n01 > 0 THEN n01 / CAST(n00 + n01 AS DOUBLE) ELSE 0 END)", "(CASE WHEN n10 + n11 > 0 THEN n11 / CAST(n10 + n11 AS DOUBLE) ELSE 0 END)"
    together, apart = _ll("(n01 + n11)", total, f"((n01 + n11) / CAST({total} AS DOUBLE))"), f"{_ll('n01', '(n00 + n01)', p01)} + {_ll('n11', '(n10 + n11)', p11)}"
    return f"""b AS (SELECT *, lag(hit) OVER (PARTITION BY model_id, level ORDER BY date) AS p FROM series),
        k AS (SELECT model_id, level, count(*) AS days, CAST(sum(hit) AS BIGINT) AS exceptions, count(*) FILTER (WHERE p = 0 AND hit = 0) AS n00, count(*) FILTER (WHERE p = 0 AND hit = 1) AS n01, count(*) FILTER (WHERE p = 1 AND hit = 0) AS n10, count(*) FILTER (WHERE p = 1 AND hit = 1) AS n11 FROM b GROUP BY 1, 2),
        r AS (SELECT *, greatest(0, -2 * ({_ll('exceptions', 'days', '(1 - level)')} - {_ll('exceptions', 'days', '(exceptions / CAST(days AS DOUBLE))')})) AS u, greatest(0, -2 * ({together} - ({apart}))) AS w FROM k)"""


SQL = {
    "calibration": f"""WITH {SERIES}, {_calibrated()} SELECT model_id, level, days, exceptions, n00, n01, n10, n11, round(u, 6) AS lr_uc, round(w, 6) AS lr_ind,
        round({erfc('sqrt(u / 2)')}, 6) AS p_uc, round({erfc('sqrt(w / 2)')}, 6) AS p_ind, round(exp(-(u + w) / 2), 6) AS p_cc FROM r""",
    "diebold_mariano_p_values": f"""WITH {_DM}, p AS (SELECT *, {erfc('abs(dm_statistic) / sqrt(2)')} AS p_value FROM dm), o AS (SELECT *, row_number() OVER (ORDER BY p_value, model_id, baseline_id) AS i, count(*) OVER () AS m FROM p)
        SELECT model_id, baseline_id, days, round(mean_difference, 6) AS mean_difference, round(dm_statistic, 5) AS dm_statistic, round(p_value, 6) AS p_value, round(max(least(1, (m - i + 1) * p_value)) OVER (ORDER BY i), 6) AS p_holm FROM o""",
    "region_prices": f"WITH {PRICES} SELECT security, date, ticker, round(close + 1.3e-8, 6) AS close, round(high, 9) AS high, round(low, 9) AS low, volume FROM prices",
    "segment_interval_join": f"WITH {PRICES}, {SEGMENTS} SELECT g.security, p.date, p.ticker, round(p.close + 1.3e-8, 6) AS close FROM prices p JOIN segments g ON p.ticker = g.ticker AND p.date BETWEEN g.s AND g.e",
    "split_factors": f"WITH {EVENTS} SELECT security, date, round(split_factor, 6) AS split_factor, split_events FROM split_days",
    "cash_dividends": f"WITH {EVENTS} SELECT security, date, round(cash_dividend, 6) AS cash_dividend, dividend_events FROM dividend_days",
    "total_returns": f"WITH {TOTAL} SELECT security, date, round(consideration + 1.3e-8, 6) AS consideration, round(total_return, 6) AS total_return, round(log_total_return, 6) AS log_total_return, quality_flag FROM daily",
    "event_dispositions": f"""WITH {EVENTS}, ev AS (SELECT event_id, security || '_' || CASE WHEN year(date) < 1998 THEN 'OLD' ELSE 'NEW' END AS ticker, date FROM splits WHERE year(date) <> 1996), {SEGMENTS},
        mapped AS (SELECT ev.event_id, g.security, ev.date FROM ev JOIN segments g ON ev.ticker = g.ticker AND ev.date BETWEEN g.s AND g.e WHERE g.security <> 'ASIA'),
        fate AS (SELECT m.*, count(*) OVER (PARTITION BY m.security, m.date) AS k, p.security IS NOT NULL AS priced FROM mapped m LEFT JOIN prices p ON p.security = m.security AND p.date = m.date)
        SELECT ev.event_id, f.security, CASE WHEN f.security IS NULL THEN 'out_of_segment' WHEN NOT f.priced THEN 'unmatched_price' WHEN f.k > 1 THEN 'duplicate_aggregated' ELSE 'applied' END AS disposition
        FROM ev LEFT JOIN fate f ON f.event_id = ev.event_id""",
    "superseded_events": f"WITH {EVENTS} SELECT event_id, security, date, factor FROM splits WHERE event_id NOT IN (SELECT event_id FROM splits WHERE event_id % 3 = 0)",
    "numeric_integrity": f"WITH {PRICES} SELECT count(*) FILTER (WHERE day(date) = 7) AS non_finite, count(*) FILTER (WHERE day(date) <> 7 AND (high < close OR low > close)) AS price_order, count(*) FILTER (WHERE day(date) = 8 AND volume > 0) AS negative_volume, count(*) AS n_rows FROM prices",
    "coverage": f"""WITH {TOTAL}, n AS (SELECT count(DISTINCT date) AS k FROM prices)
        SELECT security, count(close) AS price_days, count(log_total_return) AS return_days, round(count(close) / CAST(any_value(k) AS DOUBLE), 6) AS price_coverage,
               round(count(log_total_return) / CAST(any_value(k) - 1 AS DOUBLE), 6) AS return_coverage,
               count(close) / CAST(any_value(k) AS DOUBLE) >= 0.95 AND count(log_total_return) / CAST(any_value(k) - 1 AS DOUBLE) >= 0.95 AS included FROM daily, n GROUP BY security""",
    "early_exits": f"""WITH {EXITS}, last AS (SELECT security, max(date) AS last_date FROM panel GROUP BY 1 HAVING max(date) < DATE '2001-08-01'),
        e AS (SELECT security FROM exits) SELECT coalesce(last.security, e.security) AS security, last_date, CASE WHEN e.security IS NULL THEN 'unconfigured' WHEN last.security IS NULL THEN 'unused' ELSE 'matched' END AS finding
        FROM last FULL OUTER JOIN e ON last.security = e.security""",
    "extreme_observations": f"""WITH {TOTAL}, seen AS (SELECT security, date, total_return FROM daily WHERE abs(total_return) > 0.4)
        SELECT s.security, s.date, round(s.total_return, 6) AS total_return, CASE WHEN p.volume > 300 THEN 'large volume' END AS review, p.volume > 300 AS reviewed FROM seen s JOIN prices p USING (security, date)""",
    "lifecycle_grid": f"""WITH {PRICES}, calendar AS (SELECT DISTINCT date FROM prices), sec AS (SELECT r_name AS security, DATE '1995-01-10' + CAST(r_regionkey AS INTEGER) AS listing,
            CASE WHEN r_regionkey = 2 THEN DATE '2000-01-01' END AS cash_start, CASE WHEN r_regionkey = 2 THEN DATE '2001-01-01' END AS remove FROM region),
        g AS (SELECT s.*, c.date, CASE WHEN p.date IS NOT NULL AND NOT (day(c.date) = 13) THEN p.close END AS close, CASE WHEN day(c.date) <> 13 THEN p.volume END AS volume FROM sec s CROSS JOIN calendar c LEFT JOIN prices p ON p.security = s.security AND p.date = c.date),
        f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY security ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lc FROM g),
        t AS (SELECT *, CASE WHEN date < listing THEN 'pre_inception' WHEN date >= remove THEN 'removed' WHEN date >= cash_start THEN 'terminal_cash' WHEN close IS NOT NULL THEN 'observed'
              WHEN day(date) = 13 AND lc IS NOT NULL THEN 'verified_halt' ELSE 'unexplained_missing' END AS status FROM f)
        SELECT security, date, round(CASE WHEN status = 'verified_halt' THEN lc ELSE close END + 1.3e-8, 6) AS close, CASE WHEN status = 'verified_halt' THEN 0 ELSE volume END AS volume, status FROM t""",
    "active_schedule": f"WITH {EXITS} SELECT year, rebalance_date, security FROM schedule",
    "terminal_cash_carry": f"""WITH {EXITS}, full_panel AS (SELECT s.security, c.date, p.r FROM (SELECT DISTINCT security FROM panel) s CROSS JOIN calendar c LEFT JOIN panel p ON p.security = s.security AND p.date = c.date AND NOT (p.date >= DATE '1998-07-01' AND s.security IN (SELECT security FROM exits)))
        SELECT f.security, f.date, round(CASE WHEN e.security IS NOT NULL THEN coalesce(f.r, 0) ELSE f.r END, 8) AS simple_return FROM full_panel f LEFT JOIN exits e ON e.security = f.security AND f.date >= e.cash_start AND f.date < e.remove""",
    "share_class_composite": f"""WITH {RETURNS}, pair AS (SELECT date, sum(r) / 2 AS r, count(r) AS n FROM returns WHERE security IN ('ASIA', 'EUROPE') GROUP BY date)
        SELECT security, date, round(r, 6) AS simple_return FROM returns WHERE security NOT IN ('ASIA', 'EUROPE') UNION ALL SELECT 'EURASIA', date, round(CASE WHEN n = 2 THEN r END, 6) FROM pair""",
    "group_returns": f"WITH {GROUPS} SELECT date, group_id, round(r, 8) AS simple_return, n AS group_size, round(n / sum(n) OVER (PARTITION BY date), 8) AS portfolio_weight, round(ln(1 + r), 8) AS log_return FROM groups",
    "portfolio_reconstruction": f"""WITH {GROUPS}, direct AS (SELECT date, avg(r) AS d FROM panel GROUP BY date), w AS (SELECT date, sum(r * n) / sum(n) AS w FROM groups GROUP BY date)
        SELECT CAST(year(date) AS INTEGER) AS year, round(max(abs(d - w)), 9) AS max_error, count(*) AS days FROM direct JOIN w USING (date) GROUP BY 1""",
    "equal_weight_portfolio": f"""WITH {EXITS}, k AS (SELECT year, count(*) AS active_count FROM schedule GROUP BY 1),
        x AS (SELECT s.year, p.date, avg(p.r) AS r, count(p.r) AS n FROM panel p JOIN schedule s ON s.security = p.security AND s.year = year(p.date) GROUP BY 1, 2)
        SELECT x.date, x.year, round(x.r, 8) AS simple_return, k.active_count FROM x JOIN k USING (year) WHERE x.n = k.active_count""",
    "evaluation_year_backcast": f"""WITH {EXITS}, k AS (SELECT year, count(*) AS active_count FROM schedule GROUP BY 1),
        x AS (SELECT s.year, p.date, avg(p.r) AS r, count(p.r) AS n FROM panel p JOIN schedule s ON s.security = p.security AND p.date >= s.rebalance_date - INTERVAL 3 YEAR AND year(p.date) <= s.year GROUP BY 1, 2)
        SELECT x.year AS evaluation_year, x.date, round(x.r, 8) AS simple_return, k.active_count FROM x JOIN k USING (year) WHERE x.n = k.active_count""",
    "buy_and_hold": f"WITH {HELD} SELECT security, date, round(weight, 8) AS weight, round(r, 8) AS simple_return FROM held",
    "balanced_groups": f"WITH {HELD} SELECT date, group_id, round(sum(weight), 8) AS group_weight, round(sum(weight * r) / sum(weight), 8) AS group_return FROM held GROUP BY 1, 2",
    "pairwise_spearman": f"WITH {PAIRS} SELECT a, b, n, round(spearman, 6) AS spearman, round(sqrt((1 - spearman) / 2), 6) AS distance FROM pairs",
    "dependence_gap": f"""WITH {PAIRS}, g AS (SELECT p.spearman, x.group_id = y.group_id AS within, least(x.group_id, y.group_id) AS g, greatest(x.group_id, y.group_id) AS h FROM pairs p JOIN labels x ON x.security = p.a JOIN labels y ON y.security = p.b),
        cell AS (SELECT within, g, h, avg(spearman) AS m FROM g GROUP BY 1, 2, 3)
        SELECT round((SELECT avg(spearman) FROM g WHERE within), 6) AS within_mean, round((SELECT avg(spearman) FROM g WHERE NOT within), 6) AS between_mean,
               round((SELECT avg(m) FROM cell WHERE within) - (SELECT avg(m) FROM cell WHERE NOT within), 6) AS balanced_gap,
               round((SELECT avg(spearman) FROM g WHERE within) - (SELECT avg(spearman) FROM g WHERE NOT within), 6) AS gap""",
    "adjusted_rand_index": _ari("customer JOIN nation ON c_nationkey = n_nationkey", "c_mktsegment", "n_regionkey"),
    "normalized_mutual_information": _nmi("documents", "lang", "source"),
    "contingency": "SELECT lang AS l, source AS r, count(*) AS n FROM documents GROUP BY 1, 2",
    "rolling_var_es": f"WITH {FORECASTS} SELECT model_id, date, observations, round(var_95, 6) AS var_95, round(var_975, 6) AS var_975, round(var_99, 6) AS var_99, round(es_975, 6) AS es_975, round(realised_loss, 6) AS realised_loss FROM forecasts",
    "daily_scores": f"WITH {SCORES} SELECT model_id, date, round(quantile_loss_95, 7) AS quantile_loss_95, round(quantile_loss_99, 7) AS quantile_loss_99, round(fz0_975, 5) AS fz0_975, exception_95, exception_975, exception_99 FROM scores",
    "risk_model_summary": f"""WITH {MEANS} SELECT model_id, days, round(a, 8) AS mean_quantile_loss_95, round(b, 8) AS mean_quantile_loss_99, round(c, 6) AS mean_fz0_975, e95 AS exceptions_95, e975 AS exceptions_975, e99 AS exceptions_99,
        round(average_rank, 6) AS average_rank, CAST(rank() OVER (ORDER BY average_rank) + (count(*) OVER (PARTITION BY average_rank) - 1) / 2.0 AS DOUBLE) AS overall_rank FROM ranks""",
    "unconditional_coverage": f"""WITH {SERIES}, k AS (SELECT model_id, level, count(*) AS n, CAST(sum(hit) AS BIGINT) AS x FROM series GROUP BY 1, 2)
        SELECT model_id, level, n AS days, x AS exceptions, round(greatest(0, -2 * ({_ll('x', 'n', '(1 - level)')} - {_ll('x', 'n', '(x / CAST(n AS DOUBLE))')})), 6) AS lr_uc FROM k""",
    "transitions": f"""WITH {SERIES}, b AS (SELECT *, lag(hit) OVER (PARTITION BY model_id, level ORDER BY date) AS p FROM series)
        SELECT model_id, level, count(*) FILTER (WHERE p = 0 AND hit = 0) AS n00, count(*) FILTER (WHERE p = 0 AND hit = 1) AS n01, count(*) FILTER (WHERE p = 1 AND hit = 0) AS n10, count(*) FILTER (WHERE p = 1 AND hit = 1) AS n11 FROM b WHERE p IS NOT NULL GROUP BY 1, 2""",
    "diebold_mariano": f"WITH {_DM} SELECT model_id, baseline_id, days, round(mean_difference, 6) AS mean_difference, round(dm_statistic, 5) AS dm_statistic FROM dm",
    "holm_adjustment": f"""WITH {_DM}, p AS (SELECT model_id, baseline_id, {erfc('abs(dm_statistic) / sqrt(2)')} AS p FROM dm), s AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER o + 1) * p) AS q, row_number() OVER o AS i FROM p WINDOW o AS (ORDER BY p, model_id, baseline_id)),
        h AS (SELECT *, max(q) OVER (ORDER BY i) AS p_holm, least(1, min(p * (SELECT count(*) FROM p) / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh FROM s)
        SELECT model_id, baseline_id, round(p, 6) AS p, round(p_holm, 6) AS p_holm, round(p_bh, 6) AS p_bh FROM h""",
    "calendar_rebalance": f"WITH {EXITS} SELECT CAST(year(date) AS INTEGER) AS year, min(date) AS rebalance_date FROM calendar GROUP BY 1",
    "reshape_wide": f"""WITH {GROUPS} SELECT date, round(max(CASE WHEN group_id = 'AFRICA' THEN r END), 8) AS AFRICA, round(max(CASE WHEN group_id = 'AMERICA' THEN r END), 8) AS AMERICA,
        round(max(CASE WHEN group_id = 'ASIA' THEN r END), 8) AS ASIA, round(max(CASE WHEN group_id = 'EUROPE' THEN r END), 8) AS EUROPE, round(max(CASE WHEN group_id = 'MIDDLE EAST' THEN r END), 8) AS "MIDDLE EAST" FROM groups GROUP BY date""",
    "key_differences": "SELECT c_mktsegment AS segment, count(*) AS customers FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) GROUP BY 1",
    "extreme_days_top": f"WITH {RETURNS} SELECT security, date, round(r, 6) AS simple_return FROM (SELECT *, row_number() OVER (PARTITION BY security ORDER BY r DESC, date) AS k FROM returns WHERE r IS NOT NULL) WHERE k <= 5",
    "stock_shock": f"WITH {NATIONS} SELECT security, date, round(CASE WHEN security = 'NATION_1' AND date = DATE '1996-03-01' THEN 0.5 ELSE r END, 8) AS simple_return FROM panel",
    "group_shock": f"""WITH {NATIONS}, shocked AS (SELECT security, date, CASE WHEN security = 'NATION_1' AND date = DATE '1996-03-01' THEN 0.5 ELSE r END AS r FROM panel)
        SELECT date, group_id, round(avg(r), 8) AS simple_return FROM shocked JOIN labels USING (security) GROUP BY 1, 2""",
    "best_model": f"WITH {MEANS} SELECT model_id, round(average_rank, 6) AS average_rank FROM ranks ORDER BY ranks.average_rank, model_id LIMIT 1",
    "calibration_expected": f"WITH {SERIES} SELECT model_id, level, count(*) AS days, CAST(sum(hit) AS BIGINT) AS exceptions, round(count(*) * (1 - level), 4) AS expected_exceptions FROM series GROUP BY 1, 2",
}
