"""The states of tenants and their changes: tables of what an outcome does, followed by columns and by single rows alike.

A result has one outcome for a state (``outcome_of``). What the outcome does to the counters is in ``EFFECTS``; the health
that follows, and how long until the next scan, is the first row of ``RULES`` whose facts hold. A form says how values are
picked and added: ``Columns`` for a step of many tenants at once, ``Values`` for a stream's fold, where times are whole
microseconds. Both read the same tables, so they can't drift apart.
"""

from __future__ import annotations

from statistics import median as median_of
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.operators.health import LISTING_ANOMALIES, Policy, is_durable, median

MINUTE = 60_000_000  # microseconds


def keep(n: Any) -> Any:
    return n


def zero(n: Any) -> Any:
    return n * 0


def one(n: Any) -> Any:
    return n * 0 + 1


def more(n: Any) -> Any:
    return n + 1


COUNTERS = ("failures", "durable", "transient", "suspicious", "empty")
# What each outcome does to the counters, in their order.
EFFECTS = {
    "skipped": (keep, keep, keep, keep, keep),
    "doubtful": (keep, keep, keep, one, keep),
    "emptied": (zero, zero, zero, zero, more),
    "empty": (zero, zero, zero, zero, more),
    "listed": (zero, zero, zero, zero, zero),
    "odd": (more, keep, keep, more, keep),
    "gone": (more, more, zero, zero, keep),
    "limited": (more, zero, more, keep, keep),
    "failed": (more, zero, more, keep, keep),
}
SOUND = ("listed", "empty", "emptied")
COOLING = ("limited", "failed")
# Outcomes, the facts that hold as well, the health that follows, and the name of the wait.
RULES = (
    (("doubtful",), (), "temporarily_failed", "reprobe"),
    (SOUND, ("canary",), "healthy", "canary"),
    (SOUND, ("priority", "recent"), "active", "priority"),
    (SOUND, ("priority",), "healthy", "priority"),
    (SOUND, ("long_empty",), "long_empty", "long_empty"),
    (SOUND, ("recent",), "active", "active"),
    (SOUND, (), "healthy", "healthy"),
    (("odd",), (), "temporarily_failed", "reprobe"),
    (("gone",), ("dead",), "confirmed_dead", "dead"),
    (("gone",), ("suspected",), "suspected_dead", "dead"),
    (("gone",), (), "temporarily_failed", "first_durable"),
    (("limited",), (), "cooldown", "rate_limit"),
    (("failed",), (), "temporarily_failed", "transient"),
)

#: Columns of a state; where a table lacks one of them, it starts as null, or as 0 for counters.
STATE = {
    "health": "string",
    "next_at": "timestamp",
    "cooldown_until": "timestamp",
    **dict.fromkeys(COUNTERS, "int"),
    "recent_counts": "array<int>",
    "last_attempt_at": "timestamp",
    "last_success_at": "timestamp",
    "last_relevant_at": "timestamp",
    "last_nonempty_at": "timestamp",
    "last_nonempty_count": "int",
    "last_outcome": "string",
    "last_error_class": "string",
    "last_http_status": "int",
}
#: What a step reads of a result.
RESULT = ("status", "jobs_returned", "matched", "target_class", "health_only", "canary_hours", "anomaly", "gone", "limited", "listing_outcome", "error_class", "http_status")


class Columns:
    """Values of many rows: columns."""

    median = staticmethod(median)

    @staticmethod
    def pick(cases: list[tuple[Column, Any]], otherwise: Any) -> Column:
        first, *rest = cases
        found = F.when(*first)
        for test, value in rest:
            found = found.when(test, value)
        return found.otherwise(otherwise)

    @staticmethod
    def among(value: Column, names: tuple[str, ...]) -> Column:
        return value.isin(*names)

    @staticmethod
    def after(at: Column, wait: Column) -> Column:
        return at + F.make_dt_interval(F.lit(0), F.lit(0), wait)

    @staticmethod
    def since(at: Column, now: Column, wait: int) -> Column:
        return F.coalesce(at >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(wait)), F.lit(False))

    @staticmethod
    def counts(*numbers: Any) -> Column:
        return F.array(*[n if isinstance(n, Column) else F.lit(n) for n in numbers])

    @staticmethod
    def pushed(counts: Column, n: Column, most: int) -> Column:
        return F.slice(F.concat(counts, F.array(n)), F.greatest(F.size(counts) + 2 - most, F.lit(1)), F.lit(most))

    @staticmethod
    def none() -> Column:
        return F.lit(None)


class Values:
    """Values of one row: Python's own, times in microseconds."""

    @staticmethod
    def pick(cases: list[tuple[bool, Any]], otherwise: Any) -> Any:
        return next((value for test, value in cases if test), otherwise)

    @staticmethod
    def among(value: str, names: tuple[str, ...]) -> bool:
        return value in names

    @staticmethod
    def after(at: int, wait: int) -> int:
        return at + wait * MINUTE

    @staticmethod
    def since(at: int | None, now: int, wait: int) -> bool:
        return at is not None and at >= now - wait * MINUTE

    @staticmethod
    def median(counts: list[int]) -> float:
        return median_of(counts) if counts else 0

    @staticmethod
    def counts(*numbers: int) -> list[int]:
        return list(numbers)

    @staticmethod
    def pushed(counts: list[int], n: int, most: int) -> list[int]:
        return [*counts, n][-most:]

    @staticmethod
    def none() -> None:
        return None


def outcome_of(form: Any, s: Any, r: Any, p: Policy) -> Any:
    """The name of what a result is for a state. A first empty listing of a tenant that lists jobs as a rule is doubtful, a
    second one in a row is taken as such."""
    ok, nothing = r["status"] == "ok", r["jobs_returned"] == 0
    unusual = ok & nothing & (form.median(s["recent_counts"]) >= p.empty_baseline_jobs)
    cases = [(r["status"] == "skipped", "skipped"), (unusual & (s["suspicious"] < 1), "doubtful"), (unusual, "emptied"), (ok & nothing, "empty"), (ok, "listed")]
    return form.pick([*cases, (r["anomaly"], "odd"), (r["gone"], "gone"), (r["limited"], "limited")], "failed")


def counters_of(form: Any, s: Any, outcome: Any) -> dict[str, Any]:
    """The counters after an outcome."""
    return {c: form.pick([(outcome == name, effects[i](s[c])) for name, effects in EFFECTS.items()], s[c]) for i, c in enumerate(COUNTERS)}


def rest_of(form: Any, s: Any, counters: Any, r: Any, outcome: Any, now: Any, p: Policy) -> dict[str, Any]:
    """The other columns of the state after an outcome, whose new counters are ``counters``."""
    pick, sound, skipped = form.pick, form.among(outcome, SOUND), outcome == "skipped"
    relevant = pick([(sound & (r["matched"] > 0), now)], s["last_relevant_at"])
    found = sound & (r["jobs_returned"] > 0)
    watched = r["canary_hours"] > 0
    facts = {
        "canary": r["health_only"] & watched,
        "priority": r["target_class"] == "priority",
        "recent": form.since(relevant, now, p.recent_window_hours * 60),
        "long_empty": counters["empty"] >= p.long_empty_after,
        "dead": counters["durable"] >= p.dead_after,
        "suspected": counters["durable"] >= p.suspected_after,
    }
    waits = {
        "reprobe": p.empty_reprobe_minutes,
        "canary": r["canary_hours"] * 60,
        "priority": pick([(watched & (r["canary_hours"] < p.priority_hours), r["canary_hours"] * 60)], p.priority_hours * 60),
        "long_empty": p.long_empty_hours * 60,
        "active": p.active_hours * 60,
        "healthy": p.healthy_hours * 60,
        "dead": p.dead_reprobe_hours * 60,
        "first_durable": p.first_durable_hours * 60,
        "rate_limit": p.rate_limit_minutes,
        "transient": p.transient_minutes,
    }
    tests = []
    for outcomes, names, health, wait in RULES:
        test = form.among(outcome, outcomes)
        for name in names:
            test = test & facts[name]
        tests.append((test, health, waits[wait]))
    next_at = pick([(skipped, s["next_at"])], form.after(now, pick([(test, wait) for test, _, wait in tests], 0)))
    left = skipped | (outcome == "doubtful")
    return {
        "health": pick([(test, health) for test, health, _ in tests], s["health"]),
        "next_at": next_at,
        "cooldown_until": pick([(left, s["cooldown_until"]), (form.among(outcome, COOLING), next_at)], form.none()),
        "recent_counts": pick([(outcome == "emptied", form.counts(0)), (found, form.pushed(s["recent_counts"], r["jobs_returned"], p.count_window))], s["recent_counts"]),
        "last_attempt_at": pick([(skipped, s["last_attempt_at"])], now),
        "last_success_at": pick([(sound, now)], s["last_success_at"]),
        "last_relevant_at": relevant,
        "last_nonempty_at": pick([(found, now)], s["last_nonempty_at"]),
        "last_nonempty_count": pick([(found, r["jobs_returned"])], s["last_nonempty_count"]),
        "last_outcome": pick([(skipped, s["last_outcome"]), (outcome == "doubtful", LISTING_ANOMALIES[0])], r["listing_outcome"]),
        "last_error_class": pick([(skipped, s["last_error_class"]), (sound, form.none())], r["error_class"]),
        "last_http_status": pick([(skipped, s["last_http_status"]), (sound, form.none())], r["http_status"]),
    }


def step(form: Any, s: Any, r: Any, now: Any, p: Policy) -> dict[str, Any]:
    """The whole state after one result."""
    outcome = outcome_of(form, s, r, p)
    counters = counters_of(form, s, outcome)
    return {**counters, **rest_of(form, s, counters, r, outcome, now, p)}


def prepared(results: DataFrame) -> DataFrame:
    """``results`` with every column that a step reads of a result: no null where it counts or compares."""
    zero_ = {"canary_hours": "int", "matched": "int"}
    optional = {"listing_outcome": "string", "target_class": "string", "health_only": "boolean", **zero_}
    rows = results.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in results.columns})
    limited = F.coalesce(F.col("error_class") == "rate_limited", F.lit(False))
    anomaly = (F.col("error_class") == "provider_anomaly") & F.col("listing_outcome").isin(*LISTING_ANOMALIES)
    return rows.withColumns(
        {
            **{c: F.coalesce(F.col(c).cast(t), F.lit(0)) for c, t in zero_.items()},
            "health_only": F.coalesce("health_only", F.lit(False)),
            "jobs_returned": F.coalesce(F.col("jobs_returned"), F.lit(-1)),  # not known: neither none nor some
            "anomaly": F.coalesce(anomaly, F.lit(False)),
            "gone": F.coalesce(is_durable(F.col("error_class"), F.col("http_status")), F.lit(False)),
            "limited": limited,
        }
    )


def next_states(rows: DataFrame, now: Column, p: Policy = Policy()) -> DataFrame:
    """tenant and the columns of ``STATE`` after one result each. ``rows`` holds a tenant's state beside its result; columns
    of a state that aren't there are null, and counters 0, as for a tenant that was never seen."""
    missing = {c: F.lit(0) if c in COUNTERS else F.array().cast(t) if c == "recent_counts" else F.lit("healthy") if c == "health" else F.lit(None).cast("timestamp_ntz" if t == "timestamp" else t) for c, t in STATE.items() if c not in rows.columns}
    rows = prepared(rows).withColumns(missing).withColumns({**{c: F.coalesce(c, F.lit(0)) for c in COUNTERS}, "recent_counts": F.coalesce("recent_counts", F.array().cast("array<int>")), "health": F.coalesce("health", F.lit("healthy"))})
    old = {c: F.col(c) for c in STATE}
    r = {c: F.col(c) for c in RESULT}
    rows = rows.withColumn("_outcome", outcome_of(Columns, old, r, p))
    rows = rows.withColumns({f"_{c}": e for c, e in counters_of(Columns, old, F.col("_outcome")).items()})
    after = rest_of(Columns, old, {c: F.col(f"_{c}") for c in COUNTERS}, r, F.col("_outcome"), now, p)
    return rows.select("tenant", *[(F.col(f"_{c}") if c in COUNTERS else after[c]).alias(c) for c in STATE])


def tenant_step(rows: DataFrame, now: Column, p: Policy = Policy()) -> DataFrame:
    """The next state of tenants after one result each, without what is only kept for reports.

    ``rows`` holds the previous state (health, failures, durable, transient, empty, suspicious, recent_counts,
    last_relevant_at, next_at) beside the result (status, error_class, http_status, jobs_returned, matched,
    target_class, and where there is one listing_outcome). A skipped target keeps its state. A listing that a provider's
    check found empty or of an odd size is looked at again soon, and counts as suspicious until a result is sound.
    """
    return next_states(rows, now, p).select("tenant", "health", "next_at", *COUNTERS, "recent_counts")
