"""Frozen protocols: a configuration must hold exactly the frozen values, and a record exactly its columns."""

from __future__ import annotations

# The protocols' sections.
FROZEN = {
    "historical": {"window_years": 3, "minimum_observations": 700, "var_levels": [0.95, 0.975, 0.99], "es_level": 0.975},
    "margins": {"ar_absolute_limit": 0.98, "persistence_limit": 0.999, "student_t_df_minimum": 2.1, "ewma_lambda": 0.94, "pit_clip": 1e-6, "maximum_ewma_share": 0.01},
    "gaussian": {"eigenvalue_floor": 1e-8, "repair_tolerance": 1e-12, "maximum_condition_number": 1e10},
    "simulation": {"draws": 100_000, "base_seed": 5110},
    "inference": {"hac_lag": 7, "dm_family": 6, "calibration_family": 20, "alpha": 0.05, "block_length": 20, "replications": 10_000},
    "k_means": {"n_init": 100, "maximum_iterations": 500, "convergence_tolerance": 1e-10},
    "vine": {"dimension": 11, "truncation_levels": [3, 10], "student_df_minimum": 2.1, "student_df_maximum": 50.0, "maximum_failed_pairs": 0.1, "maximum_fallback_dates": 0.01},
    "coverage": {"minimum": 0.95},
}


def mismatches(config: dict, frozen: dict | None = None, path: str = "") -> dict[str, tuple]:
    """What differs, as dotted name -> (frozen, found); booleans and numbers are told apart."""
    out: dict[str, tuple] = {}
    frozen = FROZEN if frozen is None else frozen
    for key in sorted(frozen.keys() | config.keys()):
        name = f"{path}{key}"
        if key not in config or key not in frozen:
            out[name] = (frozen.get(key), config.get(key))
        elif isinstance(frozen[key], dict) and isinstance(config[key], dict):
            out |= mismatches(config[key], frozen[key], f"{name}.")
        elif frozen[key] != config[key] or isinstance(frozen[key], bool) != isinstance(config[key], bool):
            out[name] = (frozen[key], config[key])
    return out


def require(config: dict, section: str) -> None:
    found = mismatches(config, FROZEN[section])
    if found:
        raise ValueError(f"{section} protocol differs: {found}")


def expected_pairs(dimension: int, truncation: int) -> int:
    """Pair copulas of the first ``truncation`` trees."""
    return sum(dimension - t for t in range(1, truncation + 1))


def registry_issues(model_by_grouping: dict[str, str]) -> list[str]:
    """Empty names and models that two groupings share."""
    models = list(model_by_grouping.values())
    return [f"empty: {g!r} -> {m!r}" for g, m in model_by_grouping.items() if not g or not m] + sorted({f"shared: {m}" for m in models if models.count(m) > 1})


# What the configuration of each protocol must say, by section and name. A configuration may say more.
MODEL = {
    "portfolio": {"primary_return_scale": "simple", "primary_rebalancing": "daily", "membership_rebalancing": "annual", "group_weighting": "group_size", "cash_and_verified_halt_return": 0.0, "reconstruction_tolerance": 1e-12},
    "forecast": {"var_confidence_levels": [0.95, 0.975, 0.99], "es_confidence_level": 0.975, "horizon_trading_days": 1, "training_window_calendar_years": 3, "minimum_training_observations": 700},
    "historical_simulation": {"quantile_method": "inverted_empirical_cdf", "es_boundary_method": "fractional_order_statistic"},
    "marginal": {
        "primary": "AR(1)-GARCH(1,1)-Student-t", "fallback_order": ["retry_ar_garch_t", "constant_mean_garch_t", "ewma_empirical"], "estimation_return_scale": 100.0, "initial_optimizer_max_iterations": 1000,
        "retry_optimizer_max_iterations": 3000, "ar_absolute_limit": 0.98, "garch_persistence_limit": 0.999, "student_t_df_minimum": 2.1, "ewma_lambda": 0.94, "pit_clip_lower": 1e-6, "pit_clip_upper": 0.999999,
        "maximum_ewma_fit_fraction": 0.01, "drop_ar_for_insignificant_p_value": False,
    },
    "vine": {
        "dimension": 11, "primary_truncation_tree": 3, "robustness_truncation_tree": 10, "structure_selection": "dissmann_abs_kendall_tau_mst", "family_selection": "aic_sequential_mle",
        "families": ["independence", "gaussian", "student_t", "frank", "clayton", "gumbel"], "rotations_degrees": [0, 90, 180, 270], "student_t_df_minimum": 2.1, "student_t_df_maximum": 50.0,
        "pair_failure_action": "independence", "maximum_failed_pair_fraction": 0.1, "monthly_structure_failure_action": "matched_gaussian", "maximum_whole_vine_fallback_date_fraction": 0.01,
    },
    "gaussian": {"estimator": "pearson_correlation_of_normal_scores", "factorization": "cholesky", "eigenvalue_floor": 1e-8, "repair_tolerance": 1e-12, "maximum_condition_number": 1e10},
    "simulation": {"draws_per_month": 100000, "dimension": 11, "bit_generator": "PCG64DXSM", "base_seed": 5110, "seed_components": ["base_seed", "year", "month"], "common_random_numbers": True},
    "clustering": {"primary_method": "average_linkage_spearman_distance", "training_window_calendar_years": 3, "evaluation_start_year": 2020, "evaluation_end_year": 2025, "minimum_paired_fraction": 0.8},
    "inference": {
        "dm_hac_lag": 7, "dm_holm_family_size": 6, "calibration_holm_family_size": 20, "confirmatory_familywise_alpha": 0.05, "h1_block_length_trading_days": 20, "h1_bootstrap_replications": 10000,
        "h1_confidence_level": 0.95, "ml_multiple_testing": "benjamini_hochberg", "ml_fdr": 0.05,
    },
}
SCORES = ["quantile_loss_95", "quantile_loss_99", "fz0_975"]
TESTS = ["kupiec_unconditional_coverage", "christoffersen_independence"]
ML = {
    "grouping": {"evaluation_start_year": 2020, "evaluation_end_year": 2025, "training_window_calendar_years": 3, "minimum_training_observations": 700, "minimum_paired_fraction": 0.8, "portfolio_identity_tolerance": 1e-12},
    "kmeans": {"algorithm": "lloyd_kmeans_plus_plus", "n_init": 100, "maximum_iterations": 500, "convergence_tolerance": 1e-10, "bit_generator": "PCG64DXSM", "base_seed": 5110, "seed_components": ["base_seed", "year", "method_code"]},
    "spectral": {"method_code": 1, "affinity": "rbf_of_spearman_correlation_distance", "affinity_diagonal": 0.0, "laplacian": "symmetric_normalized", "row_normalize_embedding": True},
    "pca_kmeans": {"method_code": 2, "feature_preprocessing": "column_center_only", "decomposition": "full_svd", "explained_variance_threshold": 0.8, "minimum_components": 2},
}
ML_RISK = {"exploratory_inference": {"loss_scores": SCORES, "dm_hac_lag": 7, "multiplicity": "benjamini_hochberg", "family_size": 24, "false_discovery_rate": 0.05, "calibration_tests": TESTS, "calibration_confidence_levels": [0.95, 0.975, 0.99]}}
COMPOSITION = {
    "models": {"reference_model_id": "M0", "robustness_model_id": "M0_CC", "grouping_id": "none"},
    "portfolio": {"robustness_training_backcast": "evaluation_year_active_set", "weighting": "daily_rebalanced_equal_security_weight"},
    "forecast": {"window_calendar_years": 3, "minimum_training_observations": 700, "var_confidence_levels": [0.95, 0.975, 0.99], "es_confidence_level": 0.975},
    "evaluation": {"evaluation_start_year": 2020, "evaluation_end_year": 2025, "realised_loss_identity_tolerance": 1e-12, "primary_score_columns": SCORES},
    "dm": {"hac": "newey_west_bartlett", "hac_lag": 7, "multiplicity": "holm_familywise", "family_size": 3, "familywise_alpha": 0.05},
    "calibration": {"confidence_levels": [0.95, 0.99], "tests": TESTS, "multiplicity": "holm_familywise", "family_size": 8, "familywise_alpha": 0.05},
}
FULL_VINE = {
    "evaluation": {"model_ids": ["M2", "M4"], "primary_truncation_level": 3, "full_truncation_level": 10, "required_forecast_statuses": ["ok", "fallback"], "realised_loss_identity_tolerance": 1e-12, "primary_score_columns": SCORES},
    "dm": {"score_columns": SCORES, "hac": "newey_west_bartlett", "hac_lag": 7, "multiplicity": "holm_familywise", "family_size": 6, "familywise_alpha": 0.05},
    "calibration": {"confidence_levels": [0.95, 0.99], "tests": TESTS, "multiplicity": "holm_familywise", "family_size": 16, "familywise_alpha": 0.05},
}
BALANCED = {
    "portfolio": {
        "return_scale": "simple_total_return", "rebalance_frequency": "annual_first_trading_day", "initial_group_weight": "equal_one_over_nonempty_group_count", "initial_within_group_weight": "equal_one_over_group_size",
        "daily_weight_timing": "pre_return", "transaction_costs": 0.0, "portfolio_identity_tolerance": 1e-12,
    },
    "models": {"vine_truncation_tree": 3, "common_random_numbers": "reuse_primary_simulation_seed_manifest"},
    "evaluation": {"loss_scores": SCORES, "dm_hac_lag": 7, "dm_family_size": 6, "calibration_confidence_levels": [0.95, 0.99], "calibration_tests": TESTS, "calibration_family_size": 24, "familywise_alpha": 0.05},
}
SENSITIVITY = {"execution": {"model_ids": ["M0", "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8"], "vine_truncation_tree": 3, "universe_variant": "security_primary", "annual_assignments": "hold_primary_assignments_fixed"}}
REPORTING = {"analysis_role": "descriptive_reporting_only", "float_significant_digits": 12, "core_model_order": ["M0", "M1", "M2", "M3", "M4"], "ml_model_order": ["M5", "M6", "M7", "M8"], "clustering_method_order": ["gics", "hierarchical", "spectral", "pca_kmeans"]}


class ProtocolError(ValueError):
    """A configuration differs from its frozen protocol; ``found`` says where."""

    def __init__(self, name: str, found: dict):
        super().__init__(f"{name} protocol differs: {found}")
        self.found = found


def _differences(config: object, frozen: dict, path: str = "") -> dict[str, tuple]:
    """Frozen names that a configuration lacks or has with another value; booleans are no numbers, whole and broken ones are equal."""
    out: dict[str, tuple] = {}
    for name, value in frozen.items():
        own = config.get(name) if isinstance(config, dict) else None
        if isinstance(value, dict):
            out |= _differences(own, value, f"{path}{name}.")
        elif own != value or isinstance(own, bool) != isinstance(value, bool):
            out[f"{path}{name}"] = (value, own)
    return out


def _held(name: str, config: dict, frozen: dict, more: dict[str, bool] | None = None) -> None:
    found = _differences(config, frozen) | {k: (True, False) for k, ok in (more or {}).items() if not ok}
    if found:
        raise ProtocolError(name, found)


def _sections(*names: str) -> dict:
    return {n: MODEL[n] for n in names}


def historical(config: dict) -> None:
    years = config.get("clustering", {})
    _held("historical simulation", config, _sections("portfolio", "forecast", "historical_simulation"), {"years": years.get("evaluation_start_year") == 2020 and years.get("evaluation_end_year") == 2025})


def core_evaluation(evaluation: dict, model: dict) -> None:
    """Models, scores, tests and families of the core evaluation, which must be those of the model configuration."""
    inference = model.get("inference", {})
    own = {
        "models": sorted(evaluation.get("model_ids", [])) == ["M0", "M1", "M2", "M3", "M4"],
        "scores": list(evaluation.get("primary_score_columns", [])) == SCORES,
        "calibration_family": evaluation.get("calibration", {}).get("family_size") == inference.get("calibration_holm_family_size"),
        "accuracy_family": evaluation.get("dm", {}).get("family_size") == inference.get("dm_holm_family_size"),
        "hac_lag": evaluation.get("dm", {}).get("hac_lag") == inference.get("dm_hac_lag"),
        "replications": evaluation.get("h1", {}).get("replications") == inference.get("h1_bootstrap_replications"),
    }
    _held("core evaluation", model, _sections("inference"), own)


def vine(config: dict, truncation: int | None = None) -> int:
    """The truncation level to use: the primary one, or the one asked for, which must be one of the two and below the dimension."""
    own = config.get("vine", {})
    level = own.get("primary_truncation_tree") if truncation is None else truncation
    allowed = {own.get("primary_truncation_tree"), own.get("robustness_truncation_tree")}
    _held("vine", config, _sections("vine"), {"truncation": not isinstance(level, bool) and level in allowed and level < own.get("dimension", 0), "dimension": own.get("dimension") == config.get("simulation", {}).get("dimension")})
    return level


def simulation(config: dict) -> None:
    _held("Gaussian and simulation", config, _sections("gaussian", "simulation"))


def marginal(config: dict) -> None:
    m = config.get("marginal", {})
    number = lambda k, low, high: isinstance(m.get(k), (int, float)) and not isinstance(m.get(k), bool) and low < m[k] < high
    bounds = {
        "ar_bound": number("ar_absolute_limit", 0, 1), "persistence_bound": number("garch_persistence_limit", 0, 1), "df_bound": number("student_t_df_minimum", 2, 100),
        "lambda_bound": number("ewma_lambda", 0, 1), "clip_bound": number("pit_clip_lower", 0, 0.5) and number("pit_clip_upper", 0.5, 1),
    }
    _held("marginal", config, _sections("marginal", "forecast"), bounds)


def ml_grouping(config: dict) -> None:
    codes = [config.get(k, {}).get("method_code") for k in ("spectral", "pca_kmeans")]
    _held("machine-learnt grouping", config, ML, {"method_codes": len(set(codes)) == 2})


def ml_risk(ml: dict, model: dict) -> None:
    """The extension's models are new, its comparisons pair them with core models of the same dependence, and its levels are the core's."""
    models = ml.get("downstream_risk_models", {}).get("models", [])
    ids = [m.get("model_id") for m in models]
    own = ml.get("exploratory_inference", {})
    pairs = [(c.get("ml_model"), c.get("baseline_model")) for c in own.get("comparisons", [])]
    dependence = {m.get("model_id"): m.get("dependence") for m in models}
    checks = {
        "model_ids": sorted(map(str, ids)) == ["M5", "M6", "M7", "M8"],
        "comparisons": len(set(pairs)) == len(pairs) and len(pairs) * len(SCORES) == own.get("family_size"),
        "matched_dependence": all(dependence.get(c.get("ml_model")) == c.get("dependence") for c in own.get("comparisons", [])),
        "levels": own.get("calibration_confidence_levels") == model.get("forecast", {}).get("var_confidence_levels"),
        "hac_lag": own.get("dm_hac_lag") == model.get("inference", {}).get("dm_hac_lag"),
    }
    _held("machine-learnt risk", ml, ML_RISK, checks)


def balanced(config: dict) -> list[dict]:
    """The portfolios' specifications: two of them, with nothing shared between them."""
    specs, fields = config.get("portfolios", []), ("portfolio_id", "input_grouping_id", "model_grouping_id", "historical_model_id", "gaussian_model_id", "vine_model_id")
    whole = all(isinstance(p.get(f), str) and p[f] for p in specs for f in fields)
    models = [p.get(f) for p in specs for f in fields[3:]]
    unique = all(len({p.get(f) for p in specs}) == len(specs) for f in fields[:3]) and len(set(models)) == len(models)
    _held("group-balanced", config, {"portfolio": BALANCED["portfolio"]}, {"portfolios": len(specs) == 2 and whole and unique})
    return specs


def balanced_risk(config: dict, model: dict) -> None:
    specs = balanced(config)
    own = config.get("evaluation", {})
    tests = len(specs) * 3 * len(own.get("calibration_confidence_levels", [])) * len(TESTS)
    checks = {
        "calibration_family": own.get("calibration_family_size") == tests,
        "accuracy_family": own.get("dm_family_size") == len(specs) * len(SCORES),
        "truncation": config.get("models", {}).get("vine_truncation_tree") == model.get("vine", {}).get("primary_truncation_tree"),
    }
    _held("group-balanced risk", config, {k: BALANCED[k] for k in ("models", "evaluation")}, checks)


def composition(config: dict, model: dict) -> None:
    """The current-composition protocol; its window and levels are the model configuration's."""
    own, core = config.get("forecast", {}), model.get("forecast", {})
    checks = {
        "window": own.get("window_calendar_years") == core.get("training_window_calendar_years"),
        "observations": own.get("minimum_training_observations") == core.get("minimum_training_observations"),
        "levels": own.get("var_confidence_levels") == core.get("var_confidence_levels") and own.get("es_confidence_level") == core.get("es_confidence_level"),
        "unrevised": config.get("interpretation", {}).get("core_H1_H2_H3_revised") is False,
    }
    _held("current composition", config, COMPOSITION, checks)


def full_vine(config: dict, model: dict) -> None:
    own, core = config.get("evaluation", {}), model.get("vine", {})
    compared = [c.get("model_id") for c in config.get("dm", {}).get("comparisons", [])]
    checks = {
        "primary_level": own.get("primary_truncation_level") == core.get("primary_truncation_tree"),
        "full_level": own.get("full_truncation_level") == core.get("robustness_truncation_tree"),
        "whole_vine": own.get("full_truncation_level") == core.get("dimension", 0) - 1,
        "comparisons": compared == own.get("model_ids"),
        "accuracy_family": config.get("dm", {}).get("family_size") == len(compared) * len(SCORES),
    }
    _held("full vine", config, FULL_VINE, checks)


def sensitivity(config: dict, actions: list[dict]) -> None:
    """The event is one registered action with the same ticker, day, cash and primary value; scenarios have names and values of their own."""
    event, scenarios = config.get("event", {}), config.get("scenarios", [])
    found = [a for a in actions if a.get("action_id") == event.get("action_id")]
    action = found[0] if len(found) == 1 else {}
    values = [s.get("dap_value_per_old_share") for s in scenarios]
    primary = event.get("primary_dap_value_per_old_share")
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and x >= 0
    checks = {
        "action": len(found) == 1,
        "ticker": action.get("research_ticker") == event.get("ticker"),
        "date": action.get("effective_date") == event.get("effective_date"),
        "cash": action.get("cash_per_old_share") == event.get("cash_per_old_share"),
        "primary_value": action.get("contingent_value_per_old_share") == primary == config.get("evaluation", {}).get("primary_reference_dap_value_per_old_share"),
        "scenarios": len(scenarios) > 0 and len({s.get("scenario_id") for s in scenarios}) == len(scenarios) and all(map(number, values)) and len(set(values)) == len(values) and primary not in values,
    }
    _held("sensitivity", config, SENSITIVITY, checks)


def reporting(config: dict) -> None:
    """Orders, digits, labels and sources of the report."""
    orders = [*config.get("core_model_order", []), *config.get("ml_model_order", [])]
    checks = {
        "model_labels": sorted(config.get("model_labels", {})) == sorted(orders),
        "method_labels": sorted(config.get("method_labels", {})) == sorted(config.get("clustering_method_order", [])),
        "palette": sorted(config.get("palette", {})) == sorted(config.get("clustering_method_order", [])),
        "sources": bool(config.get("sources")) and all(isinstance(x, str) and x for x in config.get("sources", {}).values()),
    }
    _held("reporting", config, REPORTING, checks)
