"""Gaussian copula: fit, common random numbers, simulation and one-day portfolio forecasts, one task per month block."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import ndtr, ndtri, t_ppf

SEED = 5110
DRAWS = 100_000
LOWER, UPPER = 1e-6, 1 - 1e-6
FLOOR = 1e-8


def common_uniforms(year: int, month: int, draws: int = DRAWS, dimension: int = 11, seed: int = SEED) -> np.ndarray:
    """The same numbers for every model of a month, made where they are used."""
    return np.random.Generator(np.random.PCG64DXSM(np.random.SeedSequence([seed, year, month]))).random((draws, dimension))


def repaired(correlation: np.ndarray, floor: float = FLOOR) -> tuple[np.ndarray, bool]:
    """Symmetric, unit diagonal, eigenvalues not below ``floor``."""
    m = (correlation + correlation.T) / 2
    values, vectors = np.linalg.eigh(m)
    if values.min() < floor:
        m = (vectors * np.maximum(values, floor)) @ vectors.T
        scale = 1 / np.sqrt(np.diag(m))
        m = scale[:, None] * m * scale[None, :]
    m = (m + m.T) / 2
    np.fill_diagonal(m, 1.0)
    return m, bool(np.abs(m - correlation).max() > 1e-12)


def fit_correlation(pits: np.ndarray) -> tuple[np.ndarray, bool]:
    """Correlation of normal scores of a (dates x groups) matrix of probability transforms."""
    scores = ndtri(np.clip(pits, LOWER, UPPER))
    return repaired(np.corrcoef(scores, rowvar=False))


def dependent_uniforms(independent: np.ndarray, correlation: np.ndarray) -> np.ndarray:
    scores = ndtri(np.clip(independent, LOWER, UPPER))
    return np.clip(ndtr(scores @ np.linalg.cholesky(correlation).T), LOWER, UPPER)


def log_density(pits: np.ndarray, correlation: np.ndarray) -> np.ndarray:
    z = ndtri(np.clip(pits, LOWER, UPPER))
    _, log_det = np.linalg.slogdet(correlation)
    return -0.5 * (log_det + np.einsum("ij,ij->i", z @ (np.linalg.inv(correlation) - np.eye(len(correlation))), z))


def innovations(uniforms: np.ndarray, df: float | None, reference: np.ndarray | None = None) -> np.ndarray:
    """Unit-variance Student-t quantiles, or the reference's empirical quantiles where there are no degrees of freedom."""
    if df is None:
        ordered = np.sort(reference)
        return ordered[np.clip(np.ceil(uniforms * len(ordered)).astype(int) - 1, 0, len(ordered) - 1)]
    grid = np.linspace(LOWER, UPPER, 20_001)
    edge = np.concatenate([np.geomspace(LOWER, 1e-3, 400), grid[(grid > 1e-3) & (grid < 1 - 1e-3)], 1 - np.geomspace(1e-3, LOWER, 400)])
    return np.interp(uniforms, edge, t_ppf(edge, df)) * math.sqrt((df - 2) / df)


def var_es(losses: np.ndarray, levels: tuple[float, ...], es_level: float) -> tuple[list[float], float]:
    """Order statistics by partial selection and the fractional tail mean."""
    n = len(losses)
    ranks = [math.ceil(n * c) - 1 for c in levels]
    k = math.ceil(n * es_level)
    part = np.partition(losses, sorted({*ranks, k - 1}))
    es = (part[k:].sum() + (k - n * es_level) * part[k - 1]) / (n * (1 - es_level))
    return [float(part[r]) for r in ranks], float(es)


def validated_correlation(m: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """A finite, symmetric, positive definite matrix with a diagonal of ones."""
    m = np.asarray(m, float)
    if m.ndim != 2 or m.shape[0] != m.shape[1] or not np.isfinite(m).all():
        raise ValueError("a copula's correlation must be square and finite")
    if np.abs(m - m.T).max() > tolerance or np.abs(np.diag(m) - 1).max() > tolerance or np.linalg.eigvalsh(m)[0] <= 0:
        raise ValueError("a copula's correlation must be symmetric and positive definite, with ones on its diagonal")
    return m


def uniform_sha256(uniforms: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(uniforms, "<f8").tobytes()).hexdigest()


FORECAST = (
    "date date, model_id string, grouping_id string, refit_id string, var_95 double, var_975 double, var_99 double, es_975 double, realised_simple_return double, realised_loss double, "
    "seed_components array<bigint>, margin_fallback_count int, whole_vine_fallback boolean, forecast_status string, copula_log_score double"
)
RECORD = (
    "refit_id string, model_id string, grouping_id string, refit_date date, year int, month int, dimension int, training_days int, training_start date, training_end date, draws int, uniform_sha256 string, "
    "group_order string, correlation string, least_eigenvalue double, condition_number double, repaired boolean, truncation_level int, pair_count int, number_parameters int, log_likelihood double, aic double, bic double, "
    "whole_vine_fallback boolean, fallback_reason string, margin_ids string"
)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def block_forecasts(
    daily: DataFrame, refits: DataFrame, training: DataFrame, model_id: str, grouping_id: str, truncation: int | None = None, draws: int = DRAWS, seed: int = SEED, out: str = "forecasts"
) -> DataFrame:
    """One-day forecasts of a portfolio of groups, or the ``records`` of the copulas they come from.

    daily (refit_date, date, group_id, mean, volatility, pit, log_return, portfolio_weight), refits (refit_date, group_id, refit_id,
    df), training (refit_date, date, group_id, residual, pit). The copula is fitted on the training days that have every group, all
    before the refit date; a group without degrees of freedom draws from its own training residuals. With ``truncation`` it is
    a vine of so many trees, or the Gaussian copula where the vine can't be fitted. A month's inputs meet in one task by cogrouping on
    refit_date; its uniforms are the same for every model, are drawn there and never shuffled."""
    joined = daily.join(refits.select("refit_date", "group_id", F.col("refit_id").alias("margin_id"), "df"), ["refit_date", "group_id"])
    # renamed and back, as both sides may come from one table
    names = ["refit_date", "date", "group_id", "residual", "pit"]
    training = training.select(*names).toDF(*(f"_{x}" for x in names)).toDF(*names)
    schema = FORECAST if out == "forecasts" else RECORD

    def each(key: tuple, days: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        from . import vine

        if days.empty or train.empty:
            return pd.DataFrame(columns=_names(schema))
        refit, groups = pd.Timestamp(key[0]), sorted(days["group_id"].unique())
        if (pd.to_datetime(train["date"]) >= refit).any():
            raise ValueError(f"{refit:%Y-%m-%d}: a training day is not before the refit")
        if (pd.to_datetime(days["date"]) < refit).any():
            raise ValueError(f"{refit:%Y-%m-%d}: a forecast day precedes the refit")
        wide = train.pivot(index="date", columns="group_id", values="pit").reindex(columns=groups).dropna()
        if len(wide) < 2:
            raise ValueError(f"{refit:%Y-%m-%d}: no training days with every group")
        pits = np.clip(wide.to_numpy(float), LOWER, UPPER)
        correlation, mended = fit_correlation(pits)
        correlation = validated_correlation(correlation)
        trees, reason = vine.vine_or_gaussian(pits, truncation) if truncation else (None, None)
        refit_id = f"{model_id}:{refit:%Y-%m}" + (f":tree_{truncation}" if truncation else "")
        base = common_uniforms(refit.year, refit.month, draws, len(groups), seed)
        margins = days.groupby("group_id")[["df", "margin_id"]].first()
        if out == "records":
            eigen = np.linalg.eigvalsh(correlation)
            likelihood = float((log_density(pits, correlation) if trees is None else vine.log_density(trees, pits)).sum())
            edges = [e for t in trees or [] for e in t]
            count = len(groups) * (len(groups) - 1) // 2 if trees is None else vine.parameters(trees)
            dates = pd.to_datetime(pd.Series(wide.index))
            row = (
                refit_id, model_id, grouping_id, refit.date(), refit.year, refit.month, len(groups), len(wide), dates.min().date(), dates.max().date(), draws, uniform_sha256(base), json.dumps(groups),
                json.dumps(correlation.tolist()), float(eigen[0]), float(eigen[-1] / eigen[0]), mended, truncation, len(edges) if trees is not None else None, count, likelihood, 2 * count - 2 * likelihood,
                count * math.log(len(wide)) - 2 * likelihood, bool(truncation) and trees is None, reason, json.dumps(margins["margin_id"].reindex(groups).tolist()),
            )
            return pd.DataFrame([row], columns=_names(RECORD))
        uniforms = dependent_uniforms(base, correlation) if trees is None else np.clip(vine.simulate(trees, np.clip(base, LOWER, UPPER)), LOWER, UPPER)
        own_residuals = {g: x.to_numpy(float) for g, x in train.groupby("group_id")["residual"]}
        z = np.column_stack([innovations(uniforms[:, i], None if pd.isna(margins["df"][g]) else float(margins["df"][g]), own_residuals[g]) for i, g in enumerate(groups)])
        fallbacks, whole = int(margins["df"].isna().sum()), bool(truncation) and trees is None
        rows = []
        for date, own in days.groupby("date"):
            own = own.set_index("group_id", verify_integrity=True).reindex(groups)
            numbers = own[["mean", "volatility", "portfolio_weight", "log_return", "pit"]].to_numpy(float)
            if not np.isfinite(numbers).all() or (numbers[:, 1] <= 0).any():
                raise ValueError(f"{date}: a group has no margin")
            w = numbers[:, 2]
            if (w <= 0).any() or abs(w.sum() - 1) > 1e-12:
                raise ValueError(f"{date}: portfolio weights must be positive and sum to one")
            losses = -(np.expm1(numbers[:, 0] + z * numbers[:, 1]) @ w)
            (v95, v975, v99), es = var_es(losses, (0.95, 0.975, 0.99), 0.975)
            realised = float(np.expm1(numbers[:, 3]) @ w)
            at = np.clip(numbers[None, :, 4], LOWER, UPPER)
            score = float((log_density(at, correlation) if trees is None else vine.log_density(trees, at))[0])
            status = "fallback" if fallbacks or whole else "ok"
            rows.append((date, model_id, grouping_id, refit_id, v95, v975, v99, es, realised, -realised, [seed, refit.year, refit.month], fallbacks, whole, status, score))
        return pd.DataFrame(rows, columns=_names(FORECAST))

    return joined.groupBy("refit_date").cogroup(training.groupBy("refit_date")).applyInPandas(each, schema)


VINE = "refit_date date, tree int, a string, b string, under array<string>, family string, rotation int, theta double, df double, fallback_reason string"


def vine_refits(training: DataFrame, truncation: int = 3) -> DataFrame:
    """training (refit_date, date, group_id, pit) -> one row per pair copula of each block's vine, one task per block; where
    the Gaussian copula must stand in, one row with the reason. Dates that miss a group take no part."""
    from . import vine

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="group_id", values="pit").sort_index(axis=1).dropna()
        names, refit = list(wide.columns), pdf["refit_date"].iloc[0]
        trees, reason = vine.vine_or_gaussian(np.clip(wide.to_numpy(float), LOWER, UPPER), truncation)
        rows = [(refit, 0, None, None, None, None, None, None, None, reason)] if trees is None else [
            (refit, level, names[e.a], names[e.b], sorted(names[k] for k in e.under), e.pair.family, e.pair.turn, e.pair.theta, e.pair.df or None, None)
            for level, edges in enumerate(trees, 1)
            for e in edges
        ]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in VINE.split(", ")])

    return training.groupBy("refit_date").applyInPandas(each, VINE)
