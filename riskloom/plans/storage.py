"""Queries of tables that are written, committed and read again, and of streams over them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import committed, files
from ..sources import views as v
from ..streaming import refits

LINES = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _lines(s, d):
    return v.table(s, d, "lineitem").select(*LINES, "l_quantity")


def canonical_order(s, d):
    """Line items by date and key, as they lie in a committed table: each row with its place."""
    rows, path = _lines(s, d), files.workspace(s)
    committed.write(rows, path, *LINES)
    return committed.with_positions(s, path, rows.schema).select("position", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def order_issues(s, d):
    """By the table's own places, rows that come before a smaller key: none in a table written in order, one where two rows are exchanged."""
    rows, path = _lines(s, d), files.workspace(s)
    committed.write(rows, path, *LINES)
    placed = committed.with_positions(s, path, rows.schema)
    swapped = placed.withColumn("position", F.when(F.col("position") == 100, 101).when(F.col("position") == 101, 100).otherwise(F.col("position")))
    found = [committed.out_of_order(x, "position", *LINES, block=1 << 16).agg(F.count("*").alias("out_of_order"), F.min("position").alias("first")).withColumn("state", F.lit(name)) for name, x in (("written", placed), ("exchanged", swapped))]
    return found[0].unionByName(found[1])


#: Days of history and values of a fit at least.
HISTORY, LEAST = 7, 10


def streaming_refits(s, d):
    """Daily refits over the events of each user, as a stream over the table gives them."""
    events = v.table(s, d, "events")
    stream = s.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]").select(F.col("user_id").cast("string").alias("group_id"), "ts", "value")
    path = files.workspace(s)
    refits.run_available(refits.rolling_refits(stream, "day", HISTORY, LEAST), f"{path}/out", f"{path}/checkpoint")
    found = s.read.schema(refits.OUT).parquet(f"{path}/out").where(F.col("kind") == refits.ACCEPTED)
    return _shown(found)


def batch_refits(s, d):
    rows = v.table(s, d, "events").select(F.col("user_id").cast("string").alias("group_id"), "ts", "value")
    return _shown(refits.batch_refits(rows, "day", HISTORY, LEAST))


def _shown(found):
    rounded = {x: F.round(F.col(x) + 1.3e-8, 6) for x in ("mean", "sd", "residual")}
    return found.select("group_id", F.unix_micros("ts").alias("at"), F.to_date("period").alias("period"), "observations", *[x.alias(n) for n, x in rounded.items()])


_QUERIES = (canonical_order, order_issues, streaming_refits, batch_refits)

_REFITS = f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS group_id, ts, value, date_trunc('day', ts) AS period FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
p AS (SELECT DISTINCT group_id, period FROM e),
f AS (SELECT p.group_id, p.period, count(h.value) AS observations, coalesce(avg(h.value), 0) AS mean, coalesce(stddev_pop(h.value), 0) AS sd
      FROM p LEFT JOIN e h ON h.group_id = p.group_id AND h.ts < p.period AND h.ts >= p.period - INTERVAL {HISTORY} DAY GROUP BY p.group_id, p.period)
SELECT group_id, epoch_us(ts) AS at, CAST(period AS DATE) AS period, observations, round(mean + 1.3e-8, 6) AS mean, round(sd + 1.3e-8, 6) AS sd,
       CASE WHEN observations >= {LEAST} AND sd > 0 THEN round((value - mean) / sd + 1.3e-8, 6) END AS residual
FROM e JOIN f USING (group_id, period)"""


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "canonical_order": f"SELECT row_number() OVER (ORDER BY {', '.join(LINES)}) AS position, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem",
        "order_issues": "SELECT * FROM (VALUES (0, NULL, 'written'), (1, 101, 'exchanged')) AS t(out_of_order, first, state)",
        "streaming_refits": _REFITS,
        "batch_refits": _REFITS,
    }
