"""The foundation gate of many runs at once: rules over documents, facts that need each other, and what a run may claim.

Rules are a table of conditions over VARIANT columns, facts a graph; both are data to plans that read every run's row once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as doc

# Codes, statuses and scopes as records carry them, and the single blocker that an amendment may waive.
WAIVED = "authorized_point_in_time_universe_extract_absent"
FROZEN_STATUS = "frozen_before_out_of_sample_modelling"
CONFIRMATORY, PROVISIONAL, DIAGNOSTICS = "confirmatory", "provisional_research_results", "provisional_diagnostics_only"
CODES = {
    "arithmetic_bound": "portfolio_arithmetic_not_bound_to_current_panels",
    "arithmetic_files_current": "portfolio_arithmetic_inputs_changed_since_audit",
    "arithmetic_pass": "portfolio_arithmetic_not_passed",
    "construction_files_current": "construction_inputs_or_outputs_changed_since_audit",
    "construction_market_bound": "data_construction_not_bound_to_verified_market_manifest",
    "construction_pass": "data_construction_not_passed",
    "construction_universe_bound": "data_construction_not_bound_to_approved_universe",
    "market_file_current": "market_manifest_changed_since_integrity_audit",
    "market_pass": "market_input_integrity_not_passed",
    "method_frozen": "method_freeze_not_passed",
    "universe_accepted": "universe_provenance_not_passed",
    "universe_files_current": "universe_files_changed_since_audit",
}

#: What must hold before a fact is asked for.
NEEDS = {
    "arithmetic_bound": ("arithmetic_pass",),
    "arithmetic_files_current": ("arithmetic_bound",),
    "construction_files_current": ("construction_pass",),
    "construction_market_bound": ("market_pass",),
    "construction_universe_bound": ("construction_pass", "universe_accepted"),
    "market_file_current": ("market_pass",),
    "universe_files_current": ("universe_accepted",),
}

#: Documents whose records say whether a fact about files holds.
FILES = {"universe_files_current": "universe", "construction_files_current": "construction", "arithmetic_files_current": "arithmetic"}


def _at(document: str, path: str, kind: str = "string") -> str:
    return f"try_variant_get({document}, '$.{path}', '{kind}')"


def _flag(document: str, path: str, value: str) -> str:
    """Whether the document says JSON's true or false there, and not a word that could be read as one."""
    return f"to_json(variant_get({document}, '$.{path}')) <=> '{value}'"


def _same(one: str, other: str) -> str:
    return f"{one} <=> {other}"


_SCOPE = f"'{PROVISIONAL}'"
#: By issue, when it is not one: what an amendment must say, what the configuration must allow, which universe and reference it may stand for.
RULES = {
    "generic_failed_provenance_waiver_forbidden": "coalesce(to_json(variant_get(model, '$.quality_gates.allow_failed_universe_provenance')), 'null') IN ('false', 'null')",
    "model_config_must_forbid_licensed_claim": _flag("model", "provenance.licensed_provenance_claim_allowed", "false"),
    "model_config_provisional_modelling_disabled": _flag("model", "provenance.allow_modelling_with_provisional_universe", "true"),
    "model_config_reporting_scope_mismatch": _same(_at("model", "provenance.reporting_scope"), _at("amendment", "reporting_scope")),
    "provisional_amendment_does_not_allow_modelling": _flag("amendment", "modelling_allowed", "true"),
    "provisional_amendment_id_mismatch": _same(_at("amendment", "amendment_id"), _at("model", "provenance.amendment_id")),
    "provisional_amendment_must_forbid_licensed_claim": _flag("amendment", "licensed_provenance_claim_allowed", "false"),
    "provisional_amendment_not_active": _same(_at("amendment", "status"), "'active'"),
    "provisional_amendment_source_manifest_hash_mismatch": _same(_at("amendment", "expected_universe_source_manifest_sha256"), _at("universe", "source_manifest_sha256")),
    "provisional_amendment_status_invalid": f"{_at('model', 'provenance.amended_universe_provenance_status')} IS NULL OR " + _same(_at("amendment", "amended_universe_provenance_status"), _at("model", "provenance.amended_universe_provenance_status")),
    "provisional_amendment_universe_hash_mismatch": _same(_at("amendment", "expected_public_universe_sha256"), _at("universe", "public_universe_sha256")),
    "provisional_reporting_scope_invalid": _same(_at("amendment", "reporting_scope"), _SCOPE),
    "quality_gate_provisional_provenance_disabled": _flag("model", "quality_gates.allow_provisional_universe_provenance", "true"),
    "reference_file_hash_mismatch": f"current_sha256 IS NULL OR ({_same(_at('reference', 'output_sha256'), 'current_sha256')})",
    "reference_metadata_coverage_below_amendment_minimum": f"coalesce({_at('reference', 'metadata_found_count', 'long')}, 0) >= coalesce({_at('amendment', 'minimum_metadata_matches', 'long')}, n_rows)",
    "reference_missing_tickers_differ_from_amendment": "array_sort(array_distinct(transform(coalesce(try_variant_get(reference, '$.request_failures', 'array<struct<ticker:string>>'), array()), x -> x.ticker))) = "
    "array_sort(array_distinct(coalesce(try_variant_get(amendment, '$.accepted_missing_tickers', 'array<string>'), array())))",
    "reference_must_remain_nonlicensed": _flag("reference", "gate_eligibility.foundation_v2_universe_provenance", "false"),
    "reference_price_coverage_below_amendment_minimum": f"coalesce({_at('reference', 'price_found_count', 'long')}, 0) >= coalesce({_at('amendment', 'minimum_price_matches', 'long')}, n_rows)",
    "reference_row_count_invalid": _same(_at("reference", "row_count", "long"), "n_rows"),
    "reference_status_invalid": _same(_at("reference", "status"), "'provisional_non_licensed'"),
    "universe_has_nonwaivable_provenance_issue": _same(_at("universe", "status"), "'blocked'") + f" AND array_distinct(try_variant_get(universe, '$.blockers', 'array<string>')) <=> array('{WAIVED}')",
}

DOCUMENTS = ("universe", "model", "amendment", "reference")


def amendment_issues(runs: DataFrame) -> DataFrame:
    """runs (run, universe, model, amendment, reference: JSON; n_rows, current_sha256) -> (run, issues): codes, in order, of what keeps each
    run's amendment from standing in for a licensed universe. Without an amendment or a reference, that is the issue."""
    return _parsed(runs).select("run", _issues().alias("issues"))


def _parsed(runs: DataFrame) -> DataFrame:
    return runs.select("run", "n_rows", "current_sha256", *[F.parse_json(x).alias(x) for x in DOCUMENTS])


def _issues() -> Column:
    # one name, one condition: the plan evaluates all of them over a row
    codes = F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(ok), F.lit(False)), F.lit(code)) for code, ok in RULES.items()])))
    absent = F.when(F.col("amendment").isNull(), F.array(F.lit("provisional_amendment_absent"))).when(F.col("reference").isNull(), F.array(F.lit("reference_manifest_absent")))
    return F.coalesce(absent, codes)


def file_facts(documents: DataFrame, files: DataFrame) -> DataFrame:
    """documents (run, kind, body), files (path, sha256) -> (run, fact, holds): whether all records of a run's documents of a kind are those of
    the files there now. A document that names no file holds nothing."""
    own = documents.select(F.struct("run", "kind").alias("document"), "body")
    checked = doc.lineage(own, files).select("document.run", "document.kind", (F.col("status") == "pass").alias("holds"))
    fact = F.create_map(*[F.lit(x) for pair in FILES.items() for x in reversed(pair)])
    return checked.where(F.col("kind").isin(*FILES.values())).select("run", fact[F.col("kind")].alias("fact"), "holds")


def _needs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(fact, x) for fact, own in NEEDS.items() for x in own], "fact string, needs string")


def foundation_status(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """runs as for ``amendment_issues``, facts (run, fact, holds) of all that NEEDS and CODES name but universe_accepted and method_frozen ->
    (run, status, blockers, reporting_scope, readiness). pass, provisional_pass (only the waived blocker, by a valid amendment) or blocked;
    blockers are the codes of the facts that fail and are asked, with the universe's own and the amendment's issues where the universe is not
    accepted. A fact that is not given fails."""
    # issues stand beside what else a run's documents say: no run is joined with itself, which would broadcast its documents where they look small
    own = _parsed(runs.where("run IS NOT NULL")).select(
        "run", _issues().alias("issues"),
        F.expr(_same(_at("universe", "status"), "'pass'")).alias("licensed"),
        F.expr(_same(_at("model", "protocol_status"), f"'{FROZEN_STATUS}'")).alias("frozen"),
        F.expr(f"coalesce(try_variant_get(universe, '$.blockers', 'array<string>'), array('{CODES['universe_accepted']}'))").alias("own"),
    ).withColumn("waived", F.size("issues") == 0)
    stated = own.select("run", F.explode(F.create_map(F.lit("universe_accepted"), F.col("licensed") | F.col("waived"), F.lit("method_frozen"), F.col("frozen"))).alias("fact", "holds"))
    every = own.select("run", F.explode(F.array(*[F.lit(x) for x in CODES])).alias("fact"))
    given = facts.select("run", "fact", "holds").unionByName(stated)
    whole = every.join(given, ["run", "fact"], "left").select("run", "fact", F.coalesce("holds", F.lit(False)).alias("holds"))
    code = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    failing = doc.blocked(whole, _needs(runs.sparkSession)).where("asked AND NOT holds AND fact <> 'universe_accepted'")
    codes = failing.groupBy("run").agg(F.collect_set(code[F.col("fact")]).alias("codes"))
    refused = F.when(F.col("licensed") | F.col("waived"), F.array().cast("array<string>")).otherwise(F.concat("own", "issues"))
    rows = own.join(codes, "run", "left").withColumn("blockers", F.array_sort(F.array_distinct(F.concat(refused, F.coalesce("codes", F.array().cast("array<string>"))))))
    status = F.when(F.size("blockers") > 0, "blocked").when(F.col("licensed"), "pass").otherwise("provisional_pass")
    return rows.select("run", status.alias("status"), "blockers").select(
        "run", "status", "blockers", _by_status(CONFIRMATORY, PROVISIONAL, DIAGNOSTICS).alias("reporting_scope"), _by_status("pass", "pass_provisional", "blocked").alias("readiness")
    )


def _by_status(passed: str, provisional: str, otherwise: str) -> Column:
    return F.when(F.col("status") == "pass", passed).when(F.col("status") == "provisional_pass", provisional).otherwise(otherwise)
