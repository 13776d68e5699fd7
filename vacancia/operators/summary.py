"""The report of one discovery run: counts and ratios over its targets, results, candidates, changes and canaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.operators.health import ratio


def _count(test: Column, name: str) -> Column:
    return F.count_if(test).alias(name)


def target_counts(targets: DataFrame) -> DataFrame:
    """One row over planned targets: target_class, skip_reason (null for those that run), lookback_start."""
    kind, why = F.col("target_class"), F.col("skip_reason")
    runs = why.isNull()
    start = F.when(runs, F.col("lookback_start"))
    return targets.agg(
        _count(runs, "targets_planned"), _count(~runs, "targets_skipped_by_schedule"),
        *[_count(runs & (kind == k), f"{k}_targets") for k in ("priority", "canary", "normal")],
        *[_count(why == w, f"skipped_{w}") for w in ("not_due", "provider_cooldown", "normal_budget")],
        _count(why == "disabled", "disabled_targets_removed"), _count(why == "rejected", "planning_rejected"),
        F.min(start).alias("lookback_earliest"), F.max(start).alias("lookback_latest"), _count(runs & F.col("lookback_start").isNull(), "unbounded_lookback_targets"),
    )


def result_counts(results: DataFrame) -> DataFrame:
    """One row over results: status, error_class, skip_reason, jobs_returned, matched, dropped_by_cap."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return results.agg(
        _count(F.col("status") != "skipped", "targets_attempted"), _count(F.col("skip_reason") == "provider_circuit_open", "targets_skipped_by_circuit"),
        _count(F.col("status") == "ok", "provider_successes"), _count(F.col("status") == "error", "provider_errors"), _count(F.col("error_class") == "rate_limited", "provider_rate_limited"),
        total("jobs_returned", "raw_jobs_returned"), total("matched", "candidates_matched_before_cap"), total("dropped_by_cap", "candidates_dropped_by_cap"),
    )


def candidate_counts(evaluated: DataFrame) -> DataFrame:
    """One row over evaluated candidates: source_mode, preflight, exists; of all and of those out of catalogues."""
    ok, there = F.col("preflight") == "ok", F.coalesce("exists", F.lit(False))
    catalogue = F.col("source_mode") == "catalog"
    out = []
    for prefix, chosen in (("", F.lit(True)), ("catalog_", catalogue)):
        out += [_count(chosen, f"{prefix}candidates"), _count(chosen & ok, f"{prefix}preflight_checked"), _count(chosen & ok & there, f"{prefix}preflight_existing"), _count(chosen & ok & ~there, f"{prefix}preflight_missing"), _count(chosen & (F.col("preflight") == "error"), f"{prefix}preflight_errors")]
    rows = evaluated.agg(*out)
    return rows.withColumns({f"{p}preflight_existing_ratio": ratio(F.col(f"{p}preflight_existing"), F.col(f"{p}preflight_checked")) for p in ("", "catalog_")})


def change_counts(changes: DataFrame) -> DataFrame:
    """One row over tenants' changes: health, listing_outcome."""
    outcome = F.col("listing_outcome")
    return changes.agg(
        F.count("*").alias("tenant_state_changes"), *[_count(F.col("health") == h, f"tenants_marked_{h}") for h in ("active", "long_empty", "suspected_dead", "confirmed_dead")],
        _count(outcome == "listing_empty_anomaly", "tenants_scheduled_for_empty_reprobe"), _count(outcome.isin("listing_empty_anomaly", "listing_volume_anomaly"), "tenants_scheduled_for_listing_reprobe"),
    )


def canary_counts(canaries: DataFrame) -> DataFrame:
    """One row over canaries: verdict."""
    return canaries.agg(F.count("*").alias("provider_canaries"), *[_count(F.col("verdict") == v, f"provider_canaries_{v}") for v in ("healthy", "degraded", "inconclusive")])


def run_report(targets: DataFrame, results: DataFrame, evaluated: DataFrame, changes: DataFrame, canaries: DataFrame) -> DataFrame:
    """The report as one row. Every input is read once, into one row of counts; only those rows are put side by side."""
    out = target_counts(targets)
    for part in (result_counts(results), candidate_counts(evaluated), change_counts(changes), canary_counts(canaries)):
        out = out.join(F.broadcast(part))  # one row each
    return out.withColumns({"provider_success_ratio": ratio(F.col("provider_successes"), F.col("targets_attempted")), "candidate_ratio": ratio(F.col("candidates"), F.col("raw_jobs_returned"))})


# The fields of a report that count candidates by one status, and the statuses they count.
BY_STATUS = {
    "detail_status": {
        "detail_ready": ("ok",), "detail_already_present": ("already_present",), "detail_existing_skipped": ("skipped_existing",), "detail_fetch_limited": ("skipped_limit",),
        "detail_unsupported": ("unsupported_provider",), "detail_unavailable": ("unavailable",), "detail_errors": ("error",),
    },
    "import_status": {
        "import_existing": ("existing_preflight",), "import_submitted": ("submitted",), "import_reconciled": ("reconciled_after_ambiguous_post",),
        "import_detail_unavailable_skipped": ("skipped_detail_unavailable",), "import_skipped_location_ineligible": ("skipped_location_ineligible",), "import_errors": ("error",),
    },
    "location_status": {
        "location_provider_structured": ("provider_structured",), "location_missing": ("missing",),
        "location_normalized": ("normalized_city_country", "normalized_country", "normalized_country_scope", "normalized_multiple"),
    },
    "eligibility": {"location_eligible": ("eligible",), "location_ineligible": ("ineligible",), "location_unclear": ("unclear",)},
    "consistency": {"location_conflicting": ("conflicting",)},
}
# The same of pairs of a user and a candidate.
PAIRS = {
    "compatibility_requested": ("requested",), "compatibility_already_active": ("skipped_active",), "compatibility_already_succeeded": ("skipped_succeeded_current_cv", "skipped_succeeded_unknown_cv"),
    "compatibility_skipped_request_limit": ("skipped_request_limit",), "compatibility_errors": ("error_latest_check", "error_request"),
}


def _counted(column: str, fields: dict[str, tuple[str, ...]]) -> list[Column]:
    return [_count(F.col(column).isin(*names), field) for field, names in fields.items()]


def outcome_counts(evaluated: DataFrame) -> DataFrame:
    """One row over evaluated candidates: what became of their details, descriptions, imports and locations.

    ``evaluated``: the columns of ``BY_STATUS``, preflight, exists, description, and unresolved, how many observations of its
    location stayed open.
    """
    blank = F.trim(F.coalesce("description", F.lit(""))) == ""
    wanted = (F.col("preflight") == "ok") & (F.col("exists") == F.lit(False)) & (F.coalesce("detail_status", F.lit("")) != "unavailable")
    return evaluated.agg(
        *[c for column, fields in BY_STATUS.items() for c in _counted(column, fields)],
        _count(F.col("import_status").startswith("skipped_"), "import_skipped"), _count(F.col("location_status").startswith("unparsed_"), "location_unparsed"),
        F.coalesce(F.sum("unresolved"), F.lit(0)).alias("location_unresolved_observations"),
        _count(blank, "candidate_descriptions_missing"), _count(blank & wanted, "missing_descriptions_for_import"),
    )


def pair_counts(pairs: DataFrame) -> DataFrame:
    """One row over pairs of users and candidates: status, null for a pair beyond the limit of pairs."""
    return pairs.agg(F.count("*").alias("compatibility_pairs"), F.count("status").alias("compatibility_evaluated"), _count(F.col("status").isNull(), "compatibility_omitted_by_pair_limit"), *_counted("status", PAIRS))


def user_counts(users: DataFrame | None, error: str | None = None) -> DataFrame | None:
    """One row over users: saved_filters (whether there are any) and profiles (how many are valid); nulls if loading failed.
    None without users at all, as where discovery isn't made for any."""
    if users is None:
        return None
    saved, valid = F.col("saved_filters"), F.col("profiles") > 0
    row = users.agg(F.count("*").alias("discovery_users_eligible"), _count(saved, "discovery_users_with_saved_filters"), _count(valid, "discovery_users_with_valid_profiles"), _count(saved & ~valid, "discovery_users_failing_closed"))
    return row.withColumns({"discovery_users_load_status": F.lit("ok" if error is None else "error"), "discovery_users_load_error": F.lit(error).cast("string")})


def rejection_counts(rejected: DataFrame, actions: DataFrame) -> DataFrame:
    """One row over rejected candidates (reason) and what is recommended for providers' rates (action)."""
    row = rejected.agg(F.count("*").alias("candidates_rejected"), _count(F.col("reason") == "no_user_match", "candidates_rejected_no_user_match"), _count(F.col("reason") == "location_scope_filter", "location_scope_rejected"))
    rates = actions.agg(_count(F.col("action") == "decrease", "rate_recommendations_decrease"), _count(F.col("action") == "consider_increase", "rate_recommendations_increase"))
    return row.join(F.broadcast(rates))  # one row each


def outcome_report(evaluated: DataFrame, pairs: DataFrame, users: DataFrame | None, rejected: DataFrame, actions: DataFrame) -> DataFrame:
    """The second half of a run's report as one row, each input read once."""
    out = outcome_counts(evaluated)
    for part in (pair_counts(pairs), user_counts(users), rejection_counts(rejected, actions)):
        if part is not None:
            out = out.join(F.broadcast(part))  # one row each
    return out
