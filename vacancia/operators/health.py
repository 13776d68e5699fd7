"""Health of scanned providers: rates, breakers, roll-ups, and the next state of each tenant and provider."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Scheduling, breaker, monitoring and review thresholds of a provider. The defaults."""

    concurrency: int = 3
    min_interval_ms: int = 150
    rate_limit_threshold: int = 3
    transient_threshold: int = 8
    minimum_for_ratio: int = 20
    ratio_threshold: float = 0.5
    breaker_cooldown_minutes: int = 60
    degraded_minimum: int = 2
    degraded_ratio: float = 0.5
    minimum_requests: int = 20
    high_transient_ratio: float = 0.1
    healthy_success_ratio: float = 0.98
    fast_p95_ms: int = 5000
    most_concurrency: int = 6
    empty_baseline_jobs: int = 5
    empty_reprobe_minutes: int = 60
    count_window: int = 8
    recent_window_hours: int = 168
    priority_hours: int = 12
    active_hours: int = 24
    healthy_hours: int = 72
    long_empty_hours: int = 336
    long_empty_after: int = 5
    dead_after: int = 5
    suspected_after: int = 3
    dead_reprobe_hours: int = 720
    first_durable_hours: int = 24
    rate_limit_minutes: int = 120
    transient_minutes: int = 60

    @classmethod
    def of(cls, given: Mapping[str, Any], base: Policy | None = None) -> Policy:
        """A policy from settings over ``base``'s values; unknown names, other types and numbers out of range are errors.

        Counts and times are whole numbers from 1 (intervals from 0), ratios numbers from 0 to 1.
        """
        kinds = {f.name: f.type for f in fields(cls)}
        for name, value in given.items():
            if name not in kinds:
                raise ValueError(f"a policy has no {name}")
            ratio_ = kinds[name] == "float"
            if isinstance(value, bool) or not isinstance(value, int | float if ratio_ else int):
                raise ValueError(f"{name} must be a {'number' if ratio_ else 'whole number'}")
            least, most = (0, 1) if ratio_ else (0 if name == "min_interval_ms" else 1, 2**53 - 1)
            if not least <= value <= most:
                raise ValueError(f"{name} must be from {least} to {most}")
        return replace(base or cls(), **given)


def policies(settings: Mapping[str, Any]) -> dict[str, Policy]:
    """A policy by provider, each over the defaults, which have the key ``defaults``."""
    base = Policy.of(settings.get("defaults") or {})
    for name in settings:
        if not re.fullmatch(r"[a-z][a-z0-9_-]*", name):
            raise ValueError(f"{name} is no provider's name")
    return {name: Policy.of(given or {}, base) for name, given in settings.items() if name != "defaults"} | {"defaults": base}


def is_durable(error_class: Column, http_status: Column) -> Column:
    """A tenant that is gone or closed, not one that fails for now."""
    gone = (error_class == "http_4xx") & http_status.isin(404, 410)
    return F.coalesce(error_class.isin("workday_tenant_invalid", "workday_tenant_restricted") | gone, F.lit(False))


def is_transient(status: Column, error_class: Column, http_status: Column) -> Column:
    passing = error_class.isin("timeout", "rate_limited", "http_5xx", "network", "provider_error", "provider_anomaly", "provider_schema", "provider_auth")
    client = (error_class == "http_4xx") & http_status.isin(401, 403, 408)
    return F.coalesce((status == "error") & ~is_durable(error_class, http_status) & (passing | client), F.lit(False))


def error_class(code: Column, http_status: Column, name: Column, message: Column) -> Column:
    """The class of a failed request by its error code, HTTP status, name and message."""
    codes = {
        "timeout": ["ETIMEDOUT"],
        "provider_anomaly": ["PROVIDER_CANARY_MINIMUM_JOBS"],
        "workday_tenant_invalid": ["WORKDAY_TENANT_INVALID"],
        "workday_tenant_restricted": ["WORKDAY_TENANT_RESTRICTED"],
        "provider_schema": ["WORKDAY_REQUEST_REJECTED", "CSB_LISTING_SCHEMA_MISMATCH"],
        "provider_auth": ["CSB_SESSION_REJECTED", "CSB_BOOTSTRAP_TOKEN_MISSING"],
    }
    out = F.when(name == "AbortError", "timeout")
    for label, names in codes.items():
        out = out.when(code.isin(*names), label)
    network = code.isin("ECONNRESET", "ECONNREFUSED", "ENOTFOUND", "EAI_AGAIN", "EHOSTUNREACH", "ENETUNREACH")
    out = out.when(http_status == 429, "rate_limited").when(http_status.between(400, 499), "http_4xx").when(http_status >= 500, "http_5xx").when(network, "network")
    return out.when((name == "TypeError") & message.rlike("(?i)fetch failed|network|socket|connection"), "network").otherwise("provider_error")


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """Rounded half up; null where there is nothing to divide by."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def _flags(results: DataFrame) -> DataFrame:
    e, h = F.col("error_class"), F.col("http_status")
    return results.withColumns({"_attempted": F.col("status") != "skipped", "_durable": is_durable(e, h), "_transient": is_transient(F.col("status"), e, h)})


def breaker(results: DataFrame, p: Policy = Policy(), block: int = 1 << 20) -> DataFrame:
    """Each result with the first reason for which its partition's breaker opened before it, if any.

    Results count in the order of ``sequence``. A partition's breaker opens at the first result after which a threshold
    holds; later results are skipped by it and count no more.
    """
    attempted = F.col("_attempted")
    each = {"requests": attempted, "rate_limited": F.coalesce(attempted & (F.col("error_class") == "rate_limited"), F.lit(False)), "transient": attempted & F.col("_transient")}
    f = _flags(results).select("sequence", "health_partition", "status", "error_class", F.expr(f"sequence div {block}").alias("_block"), *[v.cast("int").alias(c) for c, v in each.items()])
    # Partitions are few and large: sums by blocks of the sequence first, then running sums within a block.
    upto = Window.partitionBy("health_partition").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = f.groupBy("health_partition", "_block").agg(*[F.sum(c).alias(f"_{c}") for c in each])
    before = sums.select("health_partition", "_block", *[F.coalesce(F.sum(f"_{c}").over(upto), F.lit(0)).alias(f"_{c}") for c in each])
    w = Window.partitionBy("health_partition", "_block").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    inside = f.withColumns({c: F.sum(c).over(w) for c in each})
    same = inside["health_partition"].eqNullSafe(before["health_partition"]) & inside["_block"].eqNullSafe(before["_block"])
    running = inside.join(before, same).select("sequence", inside["health_partition"], "status", "error_class", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in each])
    reason = (
        F.when(F.col("rate_limited") >= p.rate_limit_threshold, "rate_limit_threshold")
        .when(F.col("transient") >= p.transient_threshold, "transient_error_threshold")
        .when((F.col("requests") >= p.minimum_for_ratio) & (F.col("transient") / F.col("requests") >= p.ratio_threshold), "transient_error_ratio")
    )
    return running.withColumn("reason", reason)


def breaker_events(results: DataFrame, p: Policy = Policy()) -> DataFrame:
    """The event that opened each partition's breaker. Found by an aggregation; later rows need no second window."""
    tripped = breaker(results, p).where("reason is not null")
    first = tripped.groupBy("health_partition").agg(F.min_by(F.struct("sequence", "reason", "requests", "rate_limited", "transient"), "sequence").alias("e"))
    return first.select("health_partition", "e.*")


def after_breaker(results: DataFrame, p: Policy = Policy()) -> DataFrame:
    """``results`` with ``outcome``: skipped for those behind their partition's opened breaker. Partitions are few."""
    events = breaker_events(results, p).select("health_partition", F.col("sequence").alias("_opened"))
    joined = results.join(events, "health_partition", "left")
    return joined.withColumn("outcome", F.when(F.col("sequence") > F.col("_opened"), "skipped_by_circuit").otherwise(F.col("status"))).drop("_opened")


def nearest_ranks(rows: DataFrame, key: str, value: str, ranks: dict[str, tuple[int, int]], width: int = 1024) -> DataFrame:
    """key and, for each of ``ranks`` (a fraction), the least whole ``value`` that at least this share of the key's values
    doesn't exceed. Null values don't count; null keys are a key.

    Values are counted, combined before they move; blocks of ``width`` values are summed up to find the one that holds a
    rank, then the values in it. No task holds the values of a key: a window has a row a block, or ``width`` rows at most.
    """
    named = rows.select(F.struct(F.col(key).alias("of")).alias("_k"), F.col(value).cast("long").alias("_v")).where("_v is not null")
    counts = named.groupBy("_k", "_v").agg(F.count("*").alias("_n")).withColumn("_b", F.floor(F.col("_v") / width))
    blocks = counts.groupBy("_k", "_b").agg(F.sum("_n").alias("_in"))
    upto = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumns({"_upto": F.sum("_in").over(upto), "_all": F.sum("_in").over(Window.partitionBy("_k"))})
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.expr(f"(_all * {a} + {b - 1}) div {b}").alias("nth")) for name, (a, b) in ranks.items()])
    held = blocks.select("_k", "_b", (F.col("_upto") - F.col("_in")).alias("_before"), "_upto", F.explode(asked).alias("r")).where("r.nth > _before and r.nth <= _upto")
    inside = counts.join(held.drop("_upto"), ["_k", "_b"])
    within = Window.partitionBy("_k", "r.name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("_at", F.col("_before") + F.sum("_n").over(within)).where("_at >= r.nth")
    return reached.groupBy("_k").agg(*[F.min(F.when(F.col("r.name") == name, F.col("_v"))).alias(name) for name in ranks]).select(F.col("_k.of").alias(key), *ranks)


def rates(results: DataFrame, p: Policy = Policy()) -> DataFrame:
    """Counts, latencies and a recommendation a partition; percentiles are nearest ranks."""
    f = _flags(results)
    slow = nearest_ranks(f.where("_attempted"), "health_partition", "duration_ms", {"p50_ms": (1, 2), "p95_ms": (19, 20)}).withColumnRenamed("health_partition", "_hp")
    ms = F.when(F.col("_attempted"), F.col("duration_ms"))
    rows = f.groupBy("health_partition").agg(
        F.count("*").alias("planned"),
        F.count_if("_attempted").alias("attempted"),
        F.count_if(F.col("status") == "ok").alias("successes"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("error_class") == "rate_limited").alias("rate_limited"),
        F.count_if("_durable").alias("durable"),
        F.count_if("_transient").alias("transient"),
        F.sum("jobs_returned").alias("jobs"),
        F.min(ms).alias("min_ms"),
        F.round(F.sum(ms) / F.count_if("_attempted"), 3).alias("average_ms"),
        F.max(ms).alias("max_ms"),
    )
    rows = rows.join(slow, F.col("health_partition").eqNullSafe(F.col("_hp")), "left").drop("_hp")
    many = F.col("attempted") >= p.minimum_requests
    transient = F.when(F.col("attempted") == 0, 0.0).otherwise(F.col("transient") / F.col("attempted"))
    success = F.when(F.col("attempted") == 0, 1.0).otherwise(F.col("successes") / F.col("attempted"))
    fast = many & (success >= p.healthy_success_ratio) & (F.col("p95_ms") <= p.fast_p95_ms) & F.lit(p.concurrency < p.most_concurrency)
    decrease = (F.col("rate_limited") > 0) | (many & (transient >= p.high_transient_ratio))
    action = F.when(decrease, "decrease").when(fast, "consider_increase").otherwise("hold")
    return rows.withColumn("action", action).withColumn("concurrency", F.when(F.col("action") == "decrease", max(1, p.concurrency - 1)).when(F.col("action") == "consider_increase", p.concurrency + 1).otherwise(p.concurrency))


def rollup(results: DataFrame, events: DataFrame, p: Policy = Policy()) -> DataFrame:
    """Health a partition: attempts, failures that matter, their ratio, and whether it is degraded."""
    rows = _flags(results).groupBy("health_partition").agg(
        F.count("*").alias("planned"),
        F.count_if("_attempted").alias("attempted"),
        F.count_if(F.col("status") == "ok").alias("successes"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("_attempted") & F.col("_transient")).alias("health_errors"),
        F.count_if(F.col("_attempted") & F.col("_durable")).alias("durable"),
        F.sum("jobs_returned").alias("jobs"),
    )
    joined = rows.join(events.select("health_partition", F.col("reason").alias("breaker_reason")), "health_partition", "left")
    share = F.when(F.col("attempted") == 0, 0.0).otherwise(F.col("health_errors") / F.col("attempted"))
    failing = (F.col("attempted") >= p.degraded_minimum) & (share >= p.degraded_ratio)
    return joined.withColumn("health_error_ratio", F.round(share, 4)).withColumn("state", F.when(F.col("breaker_reason").isNotNull() | failing, "degraded").otherwise("healthy"))


def outcome_histogram(results: DataFrame, outcome: str) -> DataFrame:
    """How many results of each outcome a partition has."""
    return results.groupBy("health_partition", F.coalesce(F.col(outcome), F.lit("unknown")).alias("outcome")).agg(F.count("*").alias("n"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row over a whole run; ratios are null where their denominator is zero."""
    f = _flags(results)
    counts = f.agg(
        F.count("*").alias("targets"),
        F.count_if("_attempted").alias("attempted"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if("_transient").alias("transient"),
        F.count_if("_durable").alias("durable"),
        F.coalesce(F.sum("jobs_returned"), F.lit(0)).alias("jobs"),
        F.count_distinct("health_partition").alias("partitions"),
    )
    return counts.withColumns({"success_ratio": ratio(F.col("ok"), F.col("attempted")), "error_ratio": ratio(F.col("errors"), F.col("attempted")), "jobs_per_success": ratio(F.col("jobs"), F.col("ok"))})


def canary_verdict(targets: DataFrame, results: DataFrame, details: DataFrame) -> DataFrame:
    """Verdict on each canary target: its listing, and its sampled details (ready, unavailable or failed)."""
    sampled = details.groupBy("sequence").agg(F.count("*").alias("sampled"), F.count_if(F.col("detail") == "ready").alias("ready"), F.count_if(F.col("detail") == "unavailable").alias("unavailable"))
    rows = targets.join(results.select("sequence", "status", "jobs_returned"), "sequence", "left").join(sampled, "sequence", "left").na.fill(0, ["sampled", "ready", "unavailable"])
    listed = F.coalesce((F.col("status") == "ok") & (F.col("jobs_returned") >= F.col("minimum_jobs")), F.lit(False))
    need = F.col("minimum_details")
    detail = F.when(need <= 0, "not_required").when(F.col("ready") >= need, "healthy").when((F.col("sampled") > 0) & (F.col("sampled") == F.col("unavailable")), "inconclusive").otherwise("degraded")
    verdict = F.when(~listed | (F.col("detail_state") == "degraded"), "degraded").when(F.col("detail_state") == "inconclusive", "inconclusive").otherwise("healthy")
    return rows.withColumn("detail_state", detail).select("sequence", "detail_state", verdict.alias("verdict"))


def median(counts: Column) -> Column:
    """Median of an array of counts, 0 of none."""
    s, n = F.sort_array(counts), F.size(counts)
    at = lambda i: F.element_at(s, i.cast("int")).cast("double")
    return F.when(n == 0, 0.0).when(n % 2 == 1, at((n + 1) / 2)).otherwise((at(n / 2) + at(n / 2 + 1)) / 2)


def hours(ts: Column, n: Column | int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(n) if isinstance(n, int) else n)


def minutes(ts: Column, n: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))


def health_partition(provider: Column, variant: Column) -> Column:
    """``provider:variant`` in lower case, the provider alone without a variant; null without a provider."""
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.when(clean(variant).isNull(), clean(provider)).otherwise(F.concat(clean(provider), F.lit(":"), clean(variant)))


def provider_variant(provider: Column, explicit: Column, url: Column) -> Column:
    """SuccessFactors' variant: csb or rmk as given, else csb for hosts of its cloud, rmk for others; null elsewhere."""
    given = F.nullif(F.lower(F.trim(explicit)), F.lit(""))
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    own = host.rlike(r"(^|\.)jobs\.hr\.(cloud\.sap|sapcloud\.cn)$")
    wrong = F.raise_error(F.concat(F.lit("unsupported variant: "), given)).cast("string")
    variant = F.when(given.isin("csb", "rmk"), given).when(given.isNotNull(), wrong).when(own, "csb").otherwise("rmk")
    return F.when(F.lower(F.trim(provider)) == "successfactors", variant)


def catalogue_metrics(catalogues: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Each catalogue's provider with its planned numbers, and how its candidates fared (source_provider, source_mode,
    status, exists); providers without candidates have zeros."""
    checked = F.col("status") == "ok"
    rows = evaluated.where("source_mode = 'catalog'").groupBy(F.col("source_provider").alias("provider")).agg(
        F.count("*").alias("candidates"), F.count_if(checked).alias("checked"), F.count_if(checked & F.col("exists")).alias("existing"), F.count_if(F.col("status") == "error").alias("errors")
    )
    joined = catalogues.join(rows, "provider", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("candidates", "checked", "existing", "errors")}
    return joined.withColumns(zero).withColumns({"missing": F.col("checked") - F.col("existing"), "existing_ratio": F.when(F.col("checked") > 0, F.round(F.col("existing") / F.col("checked"), 4))})


# Outcomes of a listing that a provider's check finds odd.
LISTING_ANOMALIES = ("listing_empty_anomaly", "listing_volume_anomaly")


def with_previous(results: DataFrame, targets: DataFrame, previous: DataFrame) -> DataFrame:
    """Results with their target's key and the state kept under it, else under its key without a variant.

    ``targets``: sequence, provider, tenant, variant; ``previous``: state columns under the same key. ``legacy`` says that
    the state was found without the variant, and moves to the new key.
    """
    key = ["provider", "tenant"]
    named = results.join(targets, "sequence")
    state = [c for c in previous.columns if c not in (*key, "variant")]
    exact = previous.select(*[F.col(c).alias(f"_e_{c}") for c in (*key, "variant")], F.struct(*state).alias("_exact"))
    plain = previous.where("variant is null").select(*[F.col(c).alias(f"_l_{c}") for c in key], F.struct(*state).alias("_plain"))
    same = [named[c].eqNullSafe(exact[f"_e_{c}"]) for c in (*key, "variant")]
    joined = named.join(exact, same, "left").join(plain, [named[c] == plain[f"_l_{c}"] for c in key], "left")
    found = F.coalesce("_exact", "_plain")
    return joined.select(*[named[c] for c in named.columns], *[found[c].alias(c) for c in state], (F.col("_exact").isNull() & F.col("_plain").isNotNull()).alias("legacy"))


def retained_providers(before: DataFrame, observed: DataFrame) -> DataFrame:
    """Kept states of providers, without those of no variant where a variant of the provider was observed."""
    families = observed.where("variant is not null").select("provider").distinct()
    whole = before.where("variant is null").join(families, "provider", "left_anti").select(*before.columns)
    return before.where("variant is not null").unionByName(whole)


def partition_report(health: DataFrame, changes: DataFrame, canaries: DataFrame, planned: DataFrame) -> DataFrame:
    """Health of every planned or observed partition with its listings' anomalies, outcomes and canaries, and warnings.

    ``changes``: health_partition, listing_outcome; ``canaries``: health_partition, verdict.
    """
    count = lambda outcome: F.count_if(F.col("listing_outcome") == outcome)
    listed = changes.groupBy("health_partition", F.coalesce("listing_outcome", F.lit("unknown")).alias("listing_outcome")).agg(F.count("*").alias("n"))
    outcomes = listed.groupBy("health_partition").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("listing_outcome", "n")))).alias("outcomes"))  # outcomes are few
    odd = changes.groupBy("health_partition").agg(count("listing_empty_anomaly").alias("empty_anomalies"), count("listing_volume_anomaly").alias("volume_anomalies"))
    watched = canaries.groupBy("health_partition").agg(F.count("*").alias("canaries"), F.count_if(F.col("verdict") == "degraded").alias("degraded_canaries"))
    keys = planned.select("health_partition").union(health.select("health_partition")).distinct()
    rows = keys.join(health, "health_partition", "left").join(odd, "health_partition", "left").join(outcomes, "health_partition", "left").join(watched, "health_partition", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("empty_anomalies", "volume_anomalies", "canaries", "degraded_canaries")}
    rows = rows.withColumns(zero).withColumn("state", F.coalesce("state", F.lit("not_observed")))
    warnings = {"degraded": F.col("state") == "degraded", "empty_listings": F.col("empty_anomalies") > 0, "volume_changes": F.col("volume_anomalies") > 0, "canary_degraded": F.col("degraded_canaries") > 0}
    return rows.withColumn("warnings", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in warnings.items()])))


def provider_step(before: DataFrame, observed: DataFrame, events: DataFrame, now: Column, p: Policy = Policy()) -> DataFrame:
    """Providers' cooldowns: a breaker's event starts one, one that is over ends."""
    keys = before.select("health_partition").union(observed.select("health_partition")).union(events.select("health_partition")).distinct()
    rows = keys.join(before, "health_partition", "left").join(events.select("health_partition", "reason"), "health_partition", "left")
    over = F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= now)
    return rows.select(
        "health_partition",
        F.when(F.col("reason").isNotNull(), "cooldown").when(over, "healthy").otherwise(F.col("health")).alias("health"),
        F.when(F.col("reason").isNotNull(), minutes(now, p.breaker_cooldown_minutes)).when(~over, F.col("cooldown_until")).alias("cooldown_until"),
        F.coalesce("reason", "last_reason").alias("last_reason"),
    )
