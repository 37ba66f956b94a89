"""Special functions in NumPy, and pandas UDFs of those that Spark lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_erfc = np.frompyfunc(math.erfc, 1, 1)


def erfc(x) -> np.ndarray:
    return np.asarray(_erfc(np.asarray(x, float)), float)


def ndtr(x) -> np.ndarray:
    """Standard normal distribution function."""
    return 0.5 * erfc(-np.asarray(x, float) / math.sqrt(2))


# Rational approximation of the normal quantile (Acklam), refined below by Halley steps.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def ndtri(p) -> np.ndarray:
    """Standard normal quantile; 0 and 1 give infinities."""
    p = np.asarray(p, float)
    out = np.full(p.shape, np.nan)
    tail = np.minimum(p, 1 - p)
    with np.errstate(all="ignore"):
        q = np.sqrt(-2 * np.log(tail))
        far = np.polyval(_C, q) / np.polyval(_D, q)
        r = (p - 0.5) ** 2
        near = (p - 0.5) * np.polyval(_A, r) / np.polyval(_B, r)
        out = np.where(tail < 0.02425, np.where(p < 0.5, far, -far), near)
        for _ in range(2):
            error = (ndtr(out) - p) * math.sqrt(2 * math.pi) * np.exp(out * out / 2)
            out = np.where(np.isfinite(error), out - error / (1 + out * error / 2), out)
    return np.where(p == 0, -np.inf, np.where(p == 1, np.inf, out))


def beta_fraction(a: float, b: float, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.max(np.abs(d * c - 1), initial=0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x) -> np.ndarray:
    x = np.asarray(x, float)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    with np.errstate(all="ignore"):
        front = np.exp(log_front + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        value = np.where(low, front * beta_fraction(a, b, np.where(low, x, 0.0)) / a, 1 - front * beta_fraction(b, a, np.where(low, 0.0, 1 - x)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def t_cdf(x, df: float) -> np.ndarray:
    x = np.asarray(x, float)
    half = 0.5 * betainc(df / 2, 0.5, df / (df + x * x))
    return np.where(x > 0, 1 - half, half)


def t_pdf(x, df: float) -> np.ndarray:
    front = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return np.exp(front - (df + 1) / 2 * np.log1p(np.asarray(x, float) ** 2 / df))


def t_ppf(p, df: float) -> np.ndarray:
    """Student-t quantile by bisection on a bracket, then Newton steps."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, -1.0), np.full(p.shape, 1.0)
    for _ in range(200):
        wide = (t_cdf(low, df) > p) | (t_cdf(high, df) < p)
        if not wide.any():
            break
        low, high = np.where(t_cdf(low, df) > p, low * 2, low), np.where(t_cdf(high, df) < p, high * 2, high)
    for _ in range(60):
        middle = (low + high) / 2
        below = t_cdf(middle, df) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    x = (low + high) / 2
    return x - np.clip((t_cdf(x, df) - p) / np.maximum(t_pdf(x, df), 1e-300), -1e-3, 1e-3)


def vectorised(function):
    """A column function from one on arrays, made when it is used: workers import this module too."""

    def apply(column):
        def each(x: pd.Series) -> pd.Series:
            return pd.Series(function(x.to_numpy(float)), index=x.index)

        return F.pandas_udf(each, "double")(column)

    return apply


erfc_column, ndtr_column, ndtri_column = vectorised(erfc), vectorised(ndtr), vectorised(ndtri)


def chi2_1_survival(statistic):
    """Column: survival function of a chi-square with one degree of freedom."""
    return erfc_column(F.sqrt(statistic / 2))


def two_sided_normal(statistic):
    return erfc_column(F.abs(statistic) / F.sqrt(F.lit(2.0)))
