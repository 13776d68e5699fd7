"""Enrichment runs: the latest a subject, leases, expiry, completion, and the dispatch of what they produce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.operators.upserts import newest

SUBJECT = ["enricher_type", "subject_key"]
ACTIVE = ("Pending", "Queued", "Leased")
TERMINAL = ("Succeeded", "Failed", "Expired", "Superseded")
TRANSIENT_HTTP = (408, 409, 425, 429, 500, 502, 503, 504)
REQUEUED_ERRORS = ("INFERENCE_UNAVAILABLE",)
BACKOFF_MINUTES = (1, 5, 15, 60, 180)
MOST_ATTEMPTS = 8


def latest(runs: DataFrame) -> DataFrame:
    """The newest run of each subject; the greater id settles ties."""
    return newest(runs, SUBJECT, ["requested_at", "run_id"])


def with_latest(runs: DataFrame) -> DataFrame:
    """``runs`` with ``is_latest``. Runs of one subject are few; the window splits by subject."""
    w = Window.partitionBy(*SUBJECT).orderBy(F.col("requested_at").desc(), F.col("run_id").desc())
    return runs.withColumn("is_latest", F.row_number().over(w) == 1)


def supersede(runs: DataFrame) -> DataFrame:
    """All active runs of a subject but the newest active one become Superseded."""
    active = F.col("status").isin(*ACTIVE)
    w = Window.partitionBy(*SUBJECT, active).orderBy(F.col("requested_at").desc(), F.col("run_id").desc())
    stale = active & (F.row_number().over(w) > 1)
    return runs.withColumn("_stale", stale).withColumn("status", F.when(F.col("_stale"), "Superseded").otherwise(F.col("status"))).drop("_stale")


def lease_verdict(requests: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """For each requested run: null if it may be leased, else why not."""
    known = with_latest(runs).select("run_id", "status", "lease_until", "is_latest")
    held = (F.col("status") == "Leased") & (F.col("lease_until") > now)
    code = (
        F.when(F.col("status").isNull(), "RUN_NOT_FOUND")
        .when(~F.col("is_latest"), "NOT_LATEST")
        .when(~F.col("status").isin(*ACTIVE), "INVALID_STATUS")
        .when(held, "ALREADY_LEASED")
    )
    return requests.join(known, "run_id", "left").select("run_id", code.alias("error_code"))


def completion_lease_verdict(lease_token: Column, presented: Column, status: Column, lease_until: Column, is_latest: Column, now: Column) -> Column:
    """Why a worker may not complete a run: null if it may."""
    return (
        F.when(lease_token.isNull(), "LEASE_MISSING")
        .when(presented != lease_token, "LEASE_MISMATCH")
        .when(status != "Leased", "LEASE_INVALID")
        .when(lease_until < now, "LEASE_EXPIRED")
        .when(~is_latest, "NOT_LATEST")
    )


def expire(runs: DataFrame, now: Column, queued_days: int = 14, grace_minutes: int = 10, pending_minutes: int = 0) -> DataFrame:
    """Old queued and leased runs become Expired, and, if asked for, old pending ones Failed; earlier error codes stay."""
    queued = (F.col("status") == "Queued") & (F.col("requested_at") < now - F.expr(f"INTERVAL '{queued_days}' DAY"))
    leased = (F.col("status") == "Leased") & (F.col("lease_until") < now - F.expr(f"INTERVAL '{grace_minutes}' MINUTE"))
    pending = (F.col("status") == "Pending") & (F.col("requested_at") < now - F.expr(f"INTERVAL '{pending_minutes}' MINUTE")) if pending_minutes > 0 else F.lit(False)
    code = F.when(queued, "QueueTTLExceeded").when(leased, "LeaseExpired").when(pending, "PendingTooLong")
    before = F.col("error_code") if "error_code" in runs.columns else F.lit(None).cast("string")
    return runs.withColumns({"_code": code, "_before": before}).select(
        *[c for c in runs.columns if c not in ("status", "error_code")],
        F.when(F.col("_code") == "PendingTooLong", "Failed").when(F.col("_code").isNotNull(), "Expired").otherwise(F.col("status")).alias("status"),
        F.when(F.col("_code").isNotNull(), F.coalesce("_before", "_code")).otherwise(F.col("_before")).alias("error_code"),
    )


def completion_verdict(completions: DataFrame, runs: DataFrame) -> DataFrame:
    """What a reported completion leads to: already_terminal, stale_ignored, invalid, requeued or completed, and its dispatches."""
    known = with_latest(runs).select("run_id", F.col("status").alias("_status"), "is_latest")
    joined = completions.join(known, "run_id", "left")
    outcome = (
        F.when(F.col("_status").isNull(), "not_found")
        .when(F.col("_status").isin(*TERMINAL), "already_terminal")
        .when(~F.col("is_latest"), "stale_ignored")
        .when(F.col("_status") != "Leased", "invalid")
        .when((F.col("status") == "Failed") & F.col("error_code").isin(*REQUEUED_ERRORS), "requeued")
        .otherwise("completed")
    )
    rows = joined.withColumn("outcome", outcome)
    return rows.select("run_id", "outcome", ((F.col("outcome") == "completed") & (F.col("status") == "Succeeded")).cast("int").alias("dispatches"))


def queue_verdict(status: Column) -> Column:
    """Pending becomes Queued, Queued stays so; other states don't take it."""
    return F.when(status == "Pending", "queued").when(status == "Queued", "already_queued").otherwise("rejected")


def page_by_status(runs: DataFrame, status: str, limit: int, offset: int) -> DataFrame:
    """Oldest first, with the total and whether more follow."""
    rows, most = runs.where(F.col("status") == status), min(max(limit, 1), 500)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy("requested_at", "run_id").offset(offset).limit(most)
    numbered = page.join(F.broadcast(total))  # one row
    return numbered.withColumn("has_more", F.lit(offset + most) < F.col("total"))


def delivery_verdict(http_status: Column, attempts: Column, most: int = MOST_ATTEMPTS) -> Column:
    """delivered, retry or deadletter; no HTTP status stands for a lost connection."""
    transient = http_status.isNull() | http_status.isin(*TRANSIENT_HTTP)
    return F.when(http_status.between(200, 299), "delivered").when(transient & (attempts + 1 < most), "retry").otherwise("deadletter")


def stepped_backoff_minutes(attempts: Column) -> Column:
    index = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(len(BACKOFF_MINUTES) - 1)) + 1
    return F.element_at(F.array(*map(F.lit, BACKOFF_MINUTES)), index.cast("int"))


def exponential_backoff_seconds(attempts: Column, auth_error: Column | None = None, jitter: Column | None = None) -> Column:
    """30 * 2^n up to an hour, a quarter of an hour after an authorisation error. Jitter comes from outside."""
    base = F.least(F.lit(3600), (F.pow(F.lit(2.0), F.least(attempts, F.lit(8))) * 30).cast("long")).cast("long")
    if auth_error is not None:
        base = F.when(auth_error, F.lit(900).cast("long")).otherwise(base)
    return base + (jitter if jitter is not None else F.lit(0))


def batch_verdict(http_status: Column) -> Column:
    """What becomes of a sent batch of events: sent, dead or retry; a lost connection retries."""
    dead = http_status.between(400, 499) & ~http_status.isin(401, 403, 429)
    return F.when(http_status.between(200, 299), "sent").when(dead, "dead").otherwise("retry")


def dispatch_step(sent: DataFrame, now: Column) -> DataFrame:
    """Next state of rows that were being sent (dispatch_id, attempt_count, http_status): verdict, attempts, next time."""
    verdict = batch_verdict(F.col("http_status"))
    wait = exponential_backoff_seconds(F.col("attempt_count"), F.coalesce(F.col("http_status").isin(401, 403), F.lit(False)))
    return sent.select(
        "dispatch_id",
        verdict.alias("status"),
        (F.col("attempt_count") + 1).alias("attempt_count"),
        F.when(verdict == "sent", now).alias("sent_at"),
        F.when(verdict == "retry", now + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))).alias("next_attempt_at"),
    )


def dispatch_counters(step: DataFrame, exporting: bool = True) -> DataFrame:
    """One row: how many rows were tried, sent, kept for later and given up; all zero where nothing is exported."""
    rows = step if exporting else step.limit(0)
    kinds = [F.count_if(F.col("status") == s).alias(s) for s in ("sent", "retry", "dead")]
    return rows.agg(F.count("*").alias("attempted"), *kinds).withColumn("export_enabled", F.lit(exporting))


def due(dispatch: DataFrame, events: DataFrame, now: Column, limit: int) -> DataFrame:
    """The oldest rows that are pending, or to be retried by now, with their events."""
    waits = F.col("status").isin("pending", "retry") & (F.col("next_attempt_at") <= now)
    rows = dispatch.where(waits).orderBy("next_attempt_at", "dispatch_id").limit(limit)
    return rows.join(events.select("event_id", "event_name", "source_domain"), "event_id")


def dashboard(dispatch: DataFrame, now: Column) -> DataFrame:
    """One row of counts, zeros where there is nothing, and when something was last sent."""
    recent = (F.col("status") == "sent") & (F.col("sent_at") >= now - F.expr("INTERVAL '24' HOUR"))
    return dispatch.agg(
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(recent).alias("sent_last_24h"),
        F.count_if(F.col("status") == "retry").alias("failed_retryable"),
        F.count_if(F.col("status") == "dead").alias("dead"),
        F.max(F.when(F.col("status") == "sent", F.col("sent_at"))).alias("last_sent_at"),
    )


def outbox_step(outbox: DataFrame, published: DataFrame, now: Column) -> DataFrame:
    """Published rows are marked, those that failed count an attempt and keep the error."""
    joined = outbox.join(published.select("outbox_id", "ok", "error"), "outbox_id", "left")
    tried, ok = F.col("ok").isNotNull(), F.coalesce("ok", F.lit(False))
    return joined.select(
        "outbox_id",
        F.when(ok, now).otherwise(F.col("published_at")).alias("published_at"),
        (F.col("publish_attempts") + tried.cast("int")).alias("publish_attempts"),
        F.when(tried & ~ok, F.col("error")).when(ok, F.lit(None)).otherwise(F.col("last_error")).alias("last_error"),
    )


def request_decision(found: Column, status: Column, cv_version: Column, current_cv: Column, refresh_unknown: bool = False) -> Column:
    """Struct of request and reason: whether a job and user need a new run, by the latest one, if any was ``found``.

    Statuses and versions compare without case. ``refresh_unknown`` asks again where the latest run's version isn't known.
    """
    low, version = F.lower(F.coalesce(status, F.lit(""))), F.lower(cv_version)
    known = F.coalesce(version, F.lit("")) != ""
    done = F.when(version.eqNullSafe(F.lower(current_cv)), "succeeded_current_cv").when(~known & F.lit(not refresh_unknown), "succeeded_unknown_cv").otherwise("cv_changed")
    reason = F.when(~found, "missing").when(low.isin("pending", "queued", "leased", "running"), "active").when(low == "succeeded", done).when(low == "", "unknown_status").otherwise(low)
    return F.struct((~reason.isin("active", "succeeded_current_cv", "succeeded_unknown_cv")).alias("request"), reason.alias("reason"))
