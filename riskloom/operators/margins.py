"""Conditional-volatility margins: AR(1)-GARCH(1,1) with Student-t errors, and the fallbacks that always give a model.

Fits, probability transforms and daily filters run inside grouped functions: one group's series at a time, all groups and
months in parallel. Returns are scaled by 100.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import t_cdf

SCALE = 100.0
LAMBDA = 0.94
CLIP = 1e-6
AR_LIMIT, PERSISTENCE, LEAST_DF = 0.98, 0.999, 2.1
# Where a retry begins.
RETRY = {"phi": 0.95, "alpha": 0.05, "beta": 0.9, "df": 8.0}


@dataclass
class Margin:
    method: str
    level: int
    constant: float
    phi: float
    omega: float
    alpha: float
    beta: float
    df: float | None
    next_variance: float
    last_return: float
    log_likelihood: float | None


def variance_path(residuals: np.ndarray, omega: float, alpha: float, beta: float, start: float) -> np.ndarray:
    """h[0] = start, h[t+1] = omega + alpha * e[t]^2 + beta * h[t]; one more value than residuals."""
    h = np.empty(len(residuals) + 1)
    h[0] = start
    for t, e in enumerate((residuals * residuals).tolist()):
        h[t + 1] = omega + alpha * e + beta * h[t]
    return h


# Codes of what a fit can be rejected for, each with what it says.
REJECTIONS = {
    "ar_absolute_limit": lambda p: abs(p["phi"]) >= AR_LIMIT,
    "nonpositive_omega": lambda p: p["omega"] <= 0,
    "negative_alpha": lambda p: p["alpha"] < 0,
    "negative_beta": lambda p: p["beta"] < 0,
    "garch_persistence_limit": lambda p: p["alpha"] + p["beta"] >= PERSISTENCE,
    "student_t_df_minimum": lambda p: p["df"] <= LEAST_DF,
    "nonpositive_forecast_variance": lambda p: p["variance"] <= 0,
}
NONFINITE = "nonfinite_parameter_or_forecast"


def rejection_reasons(**parameters: float) -> list[str]:
    """Codes for phi, omega, alpha, beta, df and variance; numbers that are not finite are the only reason given."""
    if not all(map(math.isfinite, parameters.values())):
        return [NONFINITE]
    return [code for code, holds in REJECTIONS.items() if holds(parameters)]


def _unpack(theta: np.ndarray, autoregressive: bool) -> tuple[float, float, float, float, float, float]:
    """Free numbers -> parameters within their limits."""
    logit = lambda x: 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))
    phi = AR_LIMIT * math.tanh(theta[5]) if autoregressive else 0.0
    persistence = PERSISTENCE * logit(theta[2])
    alpha = persistence * logit(theta[3])
    return theta[0], phi, math.exp(max(-30.0, min(10.0, theta[1]))), alpha, persistence - alpha, LEAST_DF + math.exp(max(-10.0, min(5.5, theta[4])))


def _negative_likelihood(theta: np.ndarray, r: np.ndarray, autoregressive: bool) -> float:
    c, phi, omega, alpha, beta, df = _unpack(theta, autoregressive)
    e = r[1:] - c - phi * r[:-1]
    h = variance_path(e, omega, alpha, beta, float(np.var(e)))[:-1]
    front = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi * (df - 2))
    value = -float(np.sum(front - 0.5 * np.log(h) - (df + 1) / 2 * np.log1p(e * e / (h * (df - 2)))))
    return value if math.isfinite(value) else 1e12


def nelder_mead(f, start: np.ndarray, rounds: int, tolerance: float = 1e-7) -> tuple[np.ndarray, float, bool]:
    simplex = np.vstack([start, *(start + 0.25 * np.eye(len(start)))])
    values = np.array([f(x) for x in simplex])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        simplex, values = simplex[order], values[order]
        if values[-1] - values[0] < tolerance * (abs(values[0]) + tolerance):
            return simplex[0], float(values[0]), True
        centre = simplex[:-1].mean(axis=0)
        mirrored = 2 * centre - simplex[-1]
        value = f(mirrored)
        if value < values[0]:
            further = 3 * centre - 2 * simplex[-1]
            other = f(further)
            simplex[-1], values[-1] = (further, other) if other < value else (mirrored, value)
        elif value < values[-2]:
            simplex[-1], values[-1] = mirrored, value
        else:
            towards = (centre + (mirrored if value < values[-1] else simplex[-1])) / 2
            other = f(towards)
            if other < min(value, values[-1]):
                simplex[-1], values[-1] = towards, other
            else:
                simplex[1:] = (simplex[1:] + simplex[0]) / 2
                values[1:] = [f(x) for x in simplex[1:]]
    return simplex[0], float(values[0]), False


def regression_start(r: np.ndarray) -> tuple[float, float]:
    """(constant, phi) of a least-squares AR(1), phi within the retry's limit."""
    x = np.column_stack([np.ones(len(r) - 1), r[:-1]])
    constant, phi = np.linalg.lstsq(x, r[1:], rcond=None)[0]
    return float(constant), float(np.clip(phi, -RETRY["phi"], RETRY["phi"]))


def _start(r: np.ndarray, autoregressive: bool, from_regression: bool) -> np.ndarray:
    """Free numbers to begin with: the retry takes the regression's mean and its own variance parameters, others the sample mean."""
    logit = lambda p: math.log(p / (1 - p))
    variance = max(1e-8, float(np.var(r)))
    if from_regression:
        constant, phi = regression_start(r) if autoregressive and np.std(r) > 0 else (float(r.mean()), 0.0)
        alpha, beta, df = RETRY["alpha"], RETRY["beta"], RETRY["df"]
        start = [constant, math.log(variance * (1 - alpha - beta)), logit((alpha + beta) / PERSISTENCE), logit(alpha / (alpha + beta)), math.log(df - LEAST_DF), math.atanh(phi / AR_LIMIT)]
    else:
        start = [float(r.mean()), math.log(0.05 * variance), 3.0, -2.5, math.log(6.0), 0.0]
    return np.array(start if autoregressive else start[:5])


def fit_garch(r: np.ndarray, autoregressive: bool, rounds: int, from_regression: bool) -> tuple[Margin, list[str]]:
    start = _start(r, autoregressive, from_regression)
    theta, value, settled = nelder_mead(lambda x: _negative_likelihood(x, r, autoregressive), start, rounds)
    c, phi, omega, alpha, beta, df = _unpack(theta, autoregressive)
    e = r[1:] - c - phi * r[:-1]
    ahead = float(variance_path(e, omega, alpha, beta, float(np.var(e)))[-1])
    reasons = rejection_reasons(phi=phi, omega=omega, alpha=alpha, beta=beta, df=df, variance=ahead) + ([] if settled else ["not_converged"])
    return Margin("ar_garch_t" if autoregressive else "garch_t", 0, c, phi, omega, alpha, beta, df, ahead, float(r[-1]), -value), reasons


def ewma(r: np.ndarray) -> Margin:
    """Constant mean, smoothed variance; always acceptable."""
    e = r - r.mean()
    ahead = float(variance_path(e, 0.0, 1 - LAMBDA, LAMBDA, float(np.var(r, ddof=1)))[-1])
    return Margin("ewma", 3, float(r.mean()), 0.0, 0.0, 1 - LAMBDA, LAMBDA, None, ahead, float(r[-1]), None)


def select_margin(log_returns: np.ndarray) -> tuple[Margin, list[tuple[str, list[str]]]]:
    """The first acceptable of: AR fit, AR fit from regression starts with more rounds, constant mean, smoothed variance."""
    r, attempts = np.asarray(log_returns, float) * SCALE, []
    for level, (name, ar, rounds, regression) in enumerate((("initial", True, 1000, False), ("retry", True, 3000, True), ("constant", False, 3000, False))):
        try:
            margin, reasons = fit_garch(r, ar, rounds, regression)
        except (ArithmeticError, ValueError) as error:
            reasons = [type(error).__name__]
        attempts.append((name, reasons))
        if not reasons:
            margin.level = level
            return margin, attempts
    attempts.append(("ewma", []))
    return ewma(r), attempts


def residuals(margin: Margin, log_returns: np.ndarray) -> np.ndarray:
    """Standardised residuals of the series the margin was fitted on."""
    r = np.asarray(log_returns, float) * SCALE
    if margin.df is None:
        e = r - margin.constant
        return e / np.sqrt(variance_path(e, 0.0, margin.alpha, margin.beta, float(np.var(r, ddof=1)))[:-1])
    e = r[1:] - margin.constant - margin.phi * r[:-1]
    return e / np.sqrt(variance_path(e, margin.omega, margin.alpha, margin.beta, float(np.var(e)))[:-1])


def midrank(reference: np.ndarray, values: np.ndarray) -> np.ndarray:
    ordered = np.sort(reference)
    low, high = np.searchsorted(ordered, values, "left"), np.searchsorted(ordered, values, "right")
    return (low + (high - low) / 2) / len(ordered)


def transform(margin: Margin, z: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Probability transforms, clipped: the unit-variance Student-t distribution, or midranks among the fitted residuals."""
    u = midrank(reference, z) if margin.df is None else t_cdf(z * math.sqrt(margin.df / (margin.df - 2)), margin.df)
    return np.clip(u, CLIP, 1 - CLIP)


def filter_days(margin: Margin, log_returns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conditional means and volatilities of new days, in returns, with fixed parameters."""
    r = np.asarray(log_returns, float) * SCALE
    means, h, last = np.empty(len(r)), np.empty(len(r)), margin.last_return
    variance = margin.next_variance
    for t, x in enumerate(r.tolist()):
        means[t] = margin.constant + margin.phi * last
        h[t] = variance
        variance = margin.omega + margin.alpha * (x - means[t]) ** 2 + margin.beta * variance
        last = x
    return means / SCALE, np.sqrt(h) / SCALE


REFIT = "refit_id string, group_id string, refit_date date, training_start date, training_end date, observations int, evaluation_days int, method string, level int, constant double, phi double, omega double, alpha double, beta double, df double, next_variance double, last_return double, log_likelihood double, attempts string"
DAILY = "refit_id string, group_id string, refit_date date, date date, mean double, volatility double, log_return double, residual double, pit double"
TRAINING = "refit_id string, group_id string, refit_date date, date date, log_return double, residual double, pit double"
ALL = "kind string, refit_id string, group_id string, refit_date date, date date, df double, mean double, volatility double, log_return double, residual double, pit double"


def monthly(returns: DataFrame, first_refit: str | None = None, years: int = 3, least: int = 700, out: str = "refits") -> DataFrame:
    """returns (group_id, date, log_return) -> per group and month the margin refitted on the ``years`` before the month's first
    day of the group (``refits``), the filtered days of the month (``daily``), the residuals and transforms of the days that the
    margin was fitted on (``training``), or what forecasts need of the three, told apart by kind (``all``). Every month with
    ``least`` days to train on has a refit, or those from ``first_refit`` on. Repeated dates of a group fail.

    A return is sent to the months it serves, so each group and month is a task of its own, which fits once."""
    schema = {"refits": REFIT, "daily": DAILY, "training": TRAINING, "all": ALL}[out]
    names = [x.split()[0] for x in schema.split(", ")]

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        dates, r, group = pd.to_datetime(pdf["date"]), pdf["log_return"].to_numpy(float), key[0]
        if dates.duplicated().any():
            raise ValueError(f"{group}: a date is repeated")
        own = (dates >= pd.Timestamp(key[1])).to_numpy()
        if not own.any():
            return pd.DataFrame(columns=names)
        refit = dates[own].min()
        train = ((dates >= refit - pd.DateOffset(years=years)) & (dates < refit)).to_numpy()
        if train.sum() < least or (first_refit is not None and refit < pd.Timestamp(first_refit)):
            return pd.DataFrame(columns=names)
        margin, attempts = select_margin(r[train])
        head = {"refit_id": f"{group}:{refit:%Y-%m-%d}", "group_id": group, "refit_date": refit.date()}
        rows = []
        if out in ("refits", "all"):
            rows.append({"kind": "refits", **head, "training_start": dates[train].min().date(), "training_end": dates[train].max().date(), "observations": int(train.sum()), "evaluation_days": int(own.sum()), **asdict(margin), "attempts": json.dumps(attempts)})
        if out != "refits":
            fitted = residuals(margin, r[train])
            if out in ("training", "all"):
                days = dates[train][-len(fitted) :]  # an autoregressive fit has no residual of its first day
                for d, x, zz, u in zip(days, r[train][-len(fitted) :], fitted, transform(margin, fitted, fitted)):
                    rows.append({"kind": "training", **head, "date": d.date(), "log_return": x, "residual": zz, "pit": u})
            if out in ("daily", "all"):
                means, volatility = filter_days(margin, r[own])
                z = (r[own] - means) / volatility
                for d, m, s, x, zz, u in zip(dates[own], means, volatility, r[own], z, transform(margin, z, fitted)):
                    rows.append({"kind": "daily", **head, "date": d.date(), "mean": m, "volatility": s, "log_return": x, "residual": zz, "pit": u})
        return pd.DataFrame(rows, columns=names)

    month = F.to_date(F.trunc("date", "month"))
    rows = returns.where(F.col("log_return").isNotNull()).select("group_id", F.to_date("date").alias("date"), "log_return")
    served = F.sequence(month, F.add_months(month, 12 * years), F.expr("interval 1 month"))
    return rows.withColumn("month", F.explode(served)).groupBy("group_id", "month").applyInPandas(each, schema)
