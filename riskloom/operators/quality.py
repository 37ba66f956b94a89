"""Constraint operators: a query that must have no rows, or the run stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    pass


def require_none(bad: DataFrame, message: str) -> None:
    found = bad.limit(3).collect()
    if found:
        raise ConstraintError(f"{message}: {[r.asDict() for r in found]}")


def require_unique(df: DataFrame, keys: list[str], name: str) -> None:
    require_none(df.groupBy(*keys).count().where("count > 1"), f"{name}: repeated key {keys}")


def require_columns(df: DataFrame, columns: list[str], name: str) -> None:
    if set(df.columns) != set(columns):
        raise ConstraintError(f"{name}: missing {sorted(set(columns) - set(df.columns))}, extra {sorted(set(df.columns) - set(columns))}")


def require_same_keys(left: DataFrame, right: DataFrame, keys: list[str], message: str) -> None:
    """Both sides hold the same set of keys."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    require_none(a.join(b, keys, "left_anti").unionByName(b.join(a, keys, "left_anti")), message)


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf"))


def forecast_issues(forecasts: DataFrame) -> DataFrame:
    """Rows that break the forecast contract: finite numbers, value at risk rising with its level, expected shortfall
    positive and not below value at risk at its own level."""
    numbers = [F.col(c) for c in ("var_95", "var_975", "var_99", "es_975", "realised_loss")]
    bad = ~finite(numbers[0])
    for c in numbers[1:]:
        bad = bad | ~finite(c)
    return forecasts.where(
        bad | (F.col("var_95") > F.col("var_975")) | (F.col("var_975") > F.col("var_99")) | (F.col("es_975") <= 0) | (F.col("es_975") < F.col("var_975"))
    )


def numeric_integrity(daily: DataFrame) -> DataFrame:
    """One row: how many rows miss a price, break open/high/low/close order, or have a negative volume."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    missing = ~(finite(o) & finite(h) & finite(l) & finite(c))
    order = (h < F.greatest(o, c, l)) | (l > F.least(o, c, h))
    return daily.agg(
        F.count_if(missing).alias("non_finite"), F.count_if(~missing & order).alias("price_order"), F.count_if(v < 0).alias("negative_volume"), F.count("*").alias("n_rows")
    )
