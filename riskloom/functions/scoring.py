"""Column expressions of returns, losses and forecast scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accepted(value: Column, ok: Column, what: str) -> Column:
    """The value where ``ok``, null where it is null, else an error."""
    return F.when(value.isNull() | ok, value).otherwise(F.raise_error(F.lit(what)).cast("double"))


def simple_return(log_return: Column) -> Column:
    """A log return whose simple return is infinite or not a number is an error."""
    out = F.expm1(log_return)
    return _accepted(out, ~F.isnan(out) & (out != float("inf")), "a simple return is not finite")


def log_return(simple: Column) -> Column:
    """A return of -1 or less is an error."""
    return F.log1p(_accepted(simple, simple > -1, "a simple return is -1 or less"))


def realised_loss(simple: Column) -> Column:
    return -simple


def pinball(loss: Column, var: Column, confidence: float) -> Column:
    return (F.lit(confidence) - F.when(loss < var, 1.0).otherwise(0.0)) * (loss - var)


def exception(loss: Column, var: Column) -> Column:
    """Strictly above the forecast."""
    return loss > var


def fz0(loss: Column, var: Column, es: Column, confidence: float = 0.975) -> Column:
    """The joint score of value at risk and expected shortfall; an expected shortfall that is not positive or below the
    value at risk is an error."""
    score = F.when(loss > var, loss - var).otherwise(0.0) / (F.lit(1.0 - confidence) * es) + var / es + F.log(es) - 1.0
    return F.when((es > 0) & (es >= var), score).otherwise(F.raise_error(F.lit("expected shortfall must be positive and not below value at risk")))


def bernoulli_log_likelihood(successes: Column, trials: Column, probability: Column) -> Column:
    """0 * log 0 counts as 0."""
    some = F.when(successes == 0, 0.0).otherwise(successes * F.log(probability))
    rest = F.when(trials - successes == 0, 0.0).otherwise((trials - successes) * F.log1p(-probability))
    return some + rest


def share_passes(part: Column, whole: Column, most: float = 0.01) -> Column:
    return F.coalesce(part / whole <= most, F.lit(False))
