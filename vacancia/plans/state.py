"""Queries over state changes: statuses, scores, identities, runs and dispatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators import runs as R
from vacancia.operators import upserts as U
from vacancia.operators.eligibility import top_filters
from vacancia.plans.fixtures import registrar, sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _sent(dispatch: DataFrame) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (200, 401, 404, 429, 503, None))), (F.col("event_id") % 6 + 1).cast("int"))
    return R.dispatch_step(dispatch.select("dispatch_id", "attempt_count", code.alias("http_status")), now())


ORACLE_SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-01-25 00:00:00'"


def now() -> F.Column:
    return F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")


query = registrar(QUERIES, ORACLE_SQL)


# Changes made of the fixture: every third status moves on a day, and as many new ones come.
CHANGES = "SELECT job_id, CASE WHEN job_id % 2 = 0 THEN user_id ELSE user_id + 1000 END AS user_id, 'Applied' AS status, last_updated + INTERVAL '1' DAY AS last_updated FROM fx_user_job_status WHERE job_id % 3 = 0"


def _changes(status: DataFrame) -> DataFrame:
    user = F.when(F.col("job_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1000)
    return status.where("job_id % 3 = 0").select("job_id", user.alias("user_id"), F.lit("Applied").alias("status"), (F.col("last_updated") + F.expr("INTERVAL '1' DAY")).alias("last_updated"))


@query(f"WITH c AS ({CHANGES}) SELECT * FROM c UNION ALL SELECT * FROM fx_user_job_status s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.job_id = s.job_id AND c.user_id = s.user_id)", "fx_user_job_status")
def status_merge(status: DataFrame) -> DataFrame:
    return U.merge_status(status, _changes(status))[0]


@query(f"WITH c AS ({CHANGES}) SELECT c.job_id, c.user_id, coalesce(s.status, 'Unset') AS \"from\", c.status AS \"to\", c.last_updated AS ts FROM c LEFT JOIN fx_user_job_status s ON s.job_id = c.job_id AND s.user_id = c.user_id", "fx_user_job_status")
def status_merge_history(status: DataFrame) -> DataFrame:
    return U.merge_status(status, _changes(status))[1]


@query("SELECT history_id, job_id, actor_id, action AS \"to\", coalesce(lag(action) OVER (PARTITION BY job_id, actor_id ORDER BY ts, history_id), 'Unset') AS \"from\" FROM fx_history", "fx_history")
def status_transitions_lag(history: DataFrame) -> DataFrame:
    return U.transitions(history, ["job_id", "actor_id"], F.col("action"), ["ts", "history_id"]).select("history_id", "job_id", "actor_id", "to", "from")


@query("""WITH items AS (SELECT job_id, user_id, CAST(score + 0.1 AS DECIMAL(4,1)) AS score, calculated_at + (CAST(job_id % 3 AS INT) - 1) * INTERVAL '1' DAY AS calculated_at, 0 AS idx FROM fx_scores
      UNION ALL SELECT job_id, user_id + 500, score, calculated_at, 1 FROM fx_scores WHERE job_id % 4 = 0 UNION ALL SELECT job_id, user_id, CAST(9.9 AS DECIMAL(4,1)), calculated_at, 2 FROM fx_scores WHERE job_id % 5 = 0),
    one AS (SELECT *, row_number() OVER (PARTITION BY job_id, user_id ORDER BY calculated_at DESC, idx DESC) AS rn FROM items)
    SELECT o.job_id, o.user_id, CASE WHEN e.calculated_at IS NULL THEN 'Inserted' WHEN e.calculated_at > o.calculated_at THEN 'IgnoredStale' ELSE 'Updated' END AS disposition,
      CASE WHEN e.calculated_at > o.calculated_at THEN e.score ELSE o.score END AS score, CASE WHEN e.calculated_at > o.calculated_at THEN e.calculated_at ELSE o.calculated_at END AS calculated_at
    FROM one o LEFT JOIN fx_scores e ON e.job_id = o.job_id AND e.user_id = o.user_id WHERE rn = 1""", "fx_scores")
def scores_bulk_upsert(scores: DataFrame) -> DataFrame:
    day = F.make_dt_interval((F.col("job_id") % 3 - 1).cast("int"))
    items = scores.select("job_id", "user_id", (F.col("score") + F.lit("0.1").cast("decimal(4,1)")).cast("decimal(4,1)").alias("score"), (F.col("calculated_at") + day).alias("calculated_at"), F.lit(0).alias("idx"))
    items = items.unionByName(scores.where("job_id % 4 = 0").select("job_id", (F.col("user_id") + 500).alias("user_id"), "score", "calculated_at", F.lit(1).alias("idx")))
    items = items.unionByName(scores.where("job_id % 5 = 0").select("job_id", "user_id", F.lit("9.9").cast("decimal(4,1)").alias("score"), "calculated_at", F.lit(2).alias("idx")))
    return U.bulk_upsert(scores, items, ["job_id", "user_id"], "score", "calculated_at", "idx")


@query("""WITH old AS (SELECT * FROM fx_jobs WHERE job_id % 2 = 0), inc AS (SELECT * FROM fx_jobs WHERE job_id % 2 = 1),
    known AS (SELECT provider, provider_tenant, external_id, min(job_id) AS k FROM old GROUP BY ALL)
    SELECT i.job_id, i.provider, i.provider_tenant, i.external_id, CASE WHEN k IS NOT NULL THEN 'existing' WHEN row_number() OVER w = 1 THEN 'created' ELSE 'repeated' END AS disposition,
      coalesce(k, min(i.job_id) OVER (PARTITION BY i.provider, i.provider_tenant, i.external_id)) AS stands_as
    FROM inc i LEFT JOIN known USING (provider, provider_tenant, external_id) WINDOW w AS (PARTITION BY i.provider, i.provider_tenant, i.external_id ORDER BY i.job_id)""", "fx_jobs")
def identity_insert_disposition(jobs: DataFrame) -> DataFrame:
    return U.insert_disposition(jobs.where("job_id % 2 = 0"), jobs.where("job_id % 2 = 1"), ["provider", "provider_tenant", "external_id"], "job_id")


@query("""WITH inc AS (SELECT DISTINCT job_id + 1 AS job_id, country_name, city_name FROM fx_locations)
    SELECT * FROM inc i WHERE NOT EXISTS (SELECT 1 FROM fx_locations l WHERE l.job_id = i.job_id AND l.country_name = i.country_name AND l.city_name IS NOT DISTINCT FROM i.city_name)""", "fx_locations")
def locations_append_anti(locations: DataFrame) -> DataFrame:
    new = locations.select((F.col("job_id") + 1).alias("job_id"), "country_name", "city_name")
    return U.append_missing(locations, new, ["job_id", "country_name", "city_name"])


@query("""SELECT DISTINCT job_id, country_name, city_name FROM fx_locations l WHERE city_name IS NOT NULL
    OR NOT EXISTS (SELECT 1 FROM fx_locations c WHERE c.job_id = l.job_id AND c.country_name = l.country_name AND c.city_name IS NOT NULL)""", "fx_locations")
def locations_collapse(locations: DataFrame) -> DataFrame:
    return U.collapse_country_only(locations)


@query("""WITH a AS (SELECT job_id, CASE WHEN job_id % 7 = 0 THEN title || ' (new)' ELSE title END AS title, CASE WHEN job_id % 5 = 0 THEN NULL ELSE posting_company_name END AS posting_company_name, CASE WHEN job_id % 11 = 0 THEN 'Hybrid' ELSE remote_type END AS remote_type FROM fx_jobs)
    SELECT j.job_id, 'title' AS field, j.title AS "from", a.title AS "to" FROM fx_jobs j JOIN a USING (job_id) WHERE j.title IS DISTINCT FROM a.title
    UNION ALL SELECT j.job_id, 'posting_company_name', j.posting_company_name, a.posting_company_name FROM fx_jobs j JOIN a USING (job_id) WHERE j.posting_company_name IS DISTINCT FROM a.posting_company_name
    UNION ALL SELECT j.job_id, 'remote_type', NULL, NULL FROM fx_jobs j JOIN a USING (job_id) WHERE j.remote_type IS DISTINCT FROM a.remote_type""", "fx_jobs")
def field_diff(jobs: DataFrame) -> DataFrame:
    after = jobs.select(
        "job_id",
        F.when(F.col("job_id") % 7 == 0, F.concat("title", F.lit(" (new)"))).otherwise(F.col("title")).alias("title"),
        F.when(F.col("job_id") % 5 != 0, F.col("posting_company_name")).alias("posting_company_name"),
        F.when(F.col("job_id") % 11 == 0, "Hybrid").otherwise(F.col("remote_type")).alias("remote_type"),
    )
    return U.field_diff(jobs, after, "job_id", ["title", "posting_company_name", "remote_type"], flagged=["remote_type"])


@query(f"SELECT job_id, is_deleted OR job_id % 6 = 0 AS is_deleted, CASE WHEN job_id % 6 = 0 AND NOT is_deleted THEN {NOW} ELSE updated_at END AS updated_at FROM fx_jobs", "fx_jobs")
def soft_delete(jobs: DataFrame) -> DataFrame:
    return U.soft_delete(jobs, jobs.where("job_id % 6 = 0").select("job_id"), "job_id", now()).select("job_id", "is_deleted", "updated_at")


RANKED = "SELECT *, row_number() OVER (PARTITION BY enricher_type, subject_key ORDER BY requested_at DESC, run_id DESC) = 1 AS is_latest FROM fx_runs"


@query(f"SELECT run_id, enricher_type, subject_key, status, requested_at FROM ({RANKED}) WHERE is_latest", "fx_runs")
def latest_run_per_subject(runs: DataFrame) -> DataFrame:
    return R.latest(runs).select("run_id", "enricher_type", "subject_key", "status", "requested_at")


@query("""SELECT run_id, CASE WHEN status IN ('Pending', 'Queued', 'Leased') AND row_number() OVER (PARTITION BY enricher_type, subject_key, status IN ('Pending', 'Queued', 'Leased') ORDER BY requested_at DESC, run_id DESC) > 1
    THEN 'Superseded' ELSE status END AS status FROM fx_runs""", "fx_runs")
def supersede_active_runs(runs: DataFrame) -> DataFrame:
    return R.supersede(runs).select("run_id", "status")


ASKED = "SELECT run_id * 2 AS run_id FROM fx_runs"


@query(f"""SELECT a.run_id, CASE WHEN r.status IS NULL THEN 'RUN_NOT_FOUND' WHEN NOT is_latest THEN 'NOT_LATEST' WHEN r.status NOT IN ('Pending', 'Queued', 'Leased') THEN 'INVALID_STATUS'
    WHEN r.status = 'Leased' AND lease_until > {NOW} THEN 'ALREADY_LEASED' END AS error_code FROM ({ASKED}) a LEFT JOIN ({RANKED}) r ON r.run_id = a.run_id""", "fx_runs")
def lease_verdict(runs: DataFrame) -> DataFrame:
    return R.lease_verdict(runs.select((F.col("run_id") * 2).alias("run_id")), runs, now())


@query(f"""SELECT run_id, CASE WHEN status = 'Queued' AND requested_at < {NOW} - INTERVAL '14' DAY THEN 'Expired' WHEN status = 'Leased' AND lease_until < {NOW} - INTERVAL '10' MINUTE THEN 'Expired' WHEN status = 'Pending' AND requested_at < {NOW} - INTERVAL '600' MINUTE THEN 'Failed' ELSE status END AS status,
    CASE WHEN status = 'Queued' AND requested_at < {NOW} - INTERVAL '14' DAY THEN 'QueueTTLExceeded' WHEN status = 'Leased' AND lease_until < {NOW} - INTERVAL '10' MINUTE THEN 'LeaseExpired' WHEN status = 'Pending' AND requested_at < {NOW} - INTERVAL '600' MINUTE THEN 'PendingTooLong' END AS error_code FROM fx_runs""", "fx_runs")
def run_expiry(runs: DataFrame) -> DataFrame:
    return R.expire(runs, now(), pending_minutes=600).select("run_id", "status", "error_code")


@query(f"""WITH c AS (SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'Failed' ELSE 'Succeeded' END AS status, CASE WHEN run_id % 6 = 0 THEN 'INFERENCE_UNAVAILABLE' END AS error_code FROM fx_runs),
    v AS (SELECT c.run_id, c.status, CASE WHEN r.status IN ('Succeeded', 'Failed', 'Expired', 'Superseded') THEN 'already_terminal' WHEN NOT is_latest THEN 'stale_ignored' WHEN r.status <> 'Leased' THEN 'invalid' WHEN c.status = 'Failed' AND error_code = 'INFERENCE_UNAVAILABLE' THEN 'requeued' ELSE 'completed' END AS outcome FROM c JOIN ({RANKED}) r USING (run_id))
    SELECT run_id, outcome, CASE WHEN outcome = 'completed' AND status = 'Succeeded' THEN 1 ELSE 0 END AS dispatches FROM v""", "fx_runs")
def completion_verdict(runs: DataFrame) -> DataFrame:
    done = runs.select("run_id", F.when(F.col("run_id") % 3 == 0, "Failed").otherwise("Succeeded").alias("status"), F.when(F.col("run_id") % 6 == 0, "INFERENCE_UNAVAILABLE").alias("error_code"))
    return R.completion_verdict(done, runs)


@query(f"""SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'LEASE_MISSING' WHEN run_id % 5 <> run_id % 7 THEN 'LEASE_MISMATCH' WHEN status <> 'Leased' THEN 'LEASE_INVALID' WHEN lease_until < {NOW} THEN 'LEASE_EXPIRED' WHEN NOT is_latest THEN 'NOT_LATEST' END AS error_code FROM ({RANKED})""", "fx_runs")
def completion_lease_verdict(runs: DataFrame) -> DataFrame:
    token = F.when(F.col("run_id") % 5 != 0, (F.col("run_id") % 5).cast("string"))
    verdict = R.completion_lease_verdict(token, (F.col("run_id") % 7).cast("string"), F.col("status"), F.col("lease_until"), F.col("is_latest"), now())
    return R.with_latest(runs).select("run_id", verdict.alias("error_code"))


@query("SELECT run_id, CASE status WHEN 'Pending' THEN 'queued' WHEN 'Queued' THEN 'already_queued' ELSE 'rejected' END AS outcome FROM fx_runs", "fx_runs")
def run_queue_verdict(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", R.queue_verdict(F.col("status")).alias("outcome"))


@query("SELECT run_id, requested_at, (SELECT count(*) FROM fx_runs WHERE status = 'Queued') AS total, 200 + 100 < (SELECT count(*) FROM fx_runs WHERE status = 'Queued') AS has_more FROM fx_runs WHERE status = 'Queued' ORDER BY requested_at, run_id LIMIT 100 OFFSET 200", "fx_runs")
def runs_status_page(runs: DataFrame) -> DataFrame:
    return R.page_by_status(runs, "Queued", 100, 200).select("run_id", "requested_at", "total", "has_more")


@query(f"SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'sent' AND sent_at >= {NOW} - INTERVAL '24' HOUR) AS sent_last_24h, count(*) FILTER (WHERE status = 'retry') AS failed_retryable, count(*) FILTER (WHERE status = 'dead') AS dead, max(sent_at) FILTER (WHERE status = 'sent') AS last_sent_at FROM fx_dispatch", "fx_dispatch")
def dispatch_dashboard(dispatch: DataFrame) -> DataFrame:
    return R.dashboard(dispatch, now())


@query(f"SELECT d.dispatch_id, d.event_id, status, next_attempt_at, event_name, source_domain FROM (SELECT * FROM fx_dispatch WHERE status IN ('pending', 'retry') AND next_attempt_at <= {NOW} ORDER BY next_attempt_at, dispatch_id LIMIT 500) d JOIN fx_events e ON e.event_id = d.event_id", "fx_dispatch", "fx_events")
def dispatch_due_topn(dispatch: DataFrame, events: DataFrame) -> DataFrame:
    return R.due(dispatch, events, now(), 500).select("dispatch_id", "event_id", "status", "next_attempt_at", "event_name", "source_domain")


HTTP = "CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 404 WHEN 3 THEN 503 WHEN 4 THEN 401 END"


@query(f"""WITH h AS (SELECT *, {HTTP} AS http FROM fx_dispatch) SELECT dispatch_id,
    CASE WHEN http BETWEEN 200 AND 299 THEN 'delivered' WHEN (http IS NULL OR http IN (408, 409, 425, 429, 500, 502, 503, 504)) AND attempt_count + 1 < 8 THEN 'retry' ELSE 'deadletter' END AS delivery,
    CASE WHEN http BETWEEN 200 AND 299 THEN 'sent' WHEN http BETWEEN 400 AND 499 AND http NOT IN (401, 403, 429) THEN 'dead' ELSE 'retry' END AS batch FROM h""", "fx_dispatch")
def dispatch_verdict(dispatch: DataFrame) -> DataFrame:
    k = F.col("event_id") % 6
    http = F.when(k == 0, 200).when(k == 1, 429).when(k == 2, 404).when(k == 3, 503).when(k == 4, 401)
    return dispatch.select("dispatch_id", R.delivery_verdict(http, F.col("attempt_count")).alias("delivery"), R.batch_verdict(http).alias("batch"))


@query("SELECT dispatch_id, CASE WHEN attempt_count <= 1 THEN 1 WHEN attempt_count = 2 THEN 5 WHEN attempt_count = 3 THEN 15 WHEN attempt_count = 4 THEN 60 ELSE 180 END AS minutes FROM fx_dispatch", "fx_dispatch")
def backoff_stepped(dispatch: DataFrame) -> DataFrame:
    return dispatch.select("dispatch_id", R.stepped_backoff_minutes(F.col("attempt_count")).alias("minutes"))


@query("SELECT dispatch_id, CASE WHEN event_id % 6 = 4 THEN 900 ELSE least(3600, 30 * CAST(pow(2, least(attempt_count, 8)) AS BIGINT)) END AS seconds FROM fx_dispatch", "fx_dispatch")
def backoff_exponential(dispatch: DataFrame) -> DataFrame:
    return dispatch.select("dispatch_id", R.exponential_backoff_seconds(F.col("attempt_count"), F.col("event_id") % 6 == 4).alias("seconds"))


@query("""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_key ORDER BY requested_at DESC, run_id DESC) AS rn FROM fx_runs) WHERE rn = 1)
    , s AS (SELECT subject_key, run_id, CASE WHEN run_id % 23 = 0 THEN NULL WHEN run_id % 13 = 0 THEN 'failed' WHEN run_id % 19 = 0 THEN 'running' WHEN run_id % 7 = 0 THEN '' ELSE lower(status) END AS s FROM l),
    r AS (SELECT subject_key, CASE WHEN s IS NULL THEN 'missing' WHEN s IN ('pending', 'queued', 'leased', 'running') THEN 'active' WHEN s = 'succeeded' THEN CASE WHEN run_id % 4 = 0 THEN 'succeeded_unknown_cv' WHEN run_id % 4 = 1 THEN 'succeeded_current_cv' ELSE 'cv_changed' END WHEN s = '' THEN 'unknown_status' ELSE s END AS reason FROM s)
    SELECT subject_key, reason, reason NOT IN ('active', 'succeeded_current_cv', 'succeeded_unknown_cv') AS request FROM r""", "fx_runs")
def compat_request_decision(runs: DataFrame) -> DataFrame:
    k = F.col("run_id")
    version = F.when(k % 4 != 0, F.concat(F.lit("V"), (k % 4).cast("string")))
    status = F.when(k % 13 == 0, "Failed").when(k % 19 == 0, "RUNNING").when(k % 7 == 0, "").otherwise(F.col("status"))
    return R.latest(runs).select("subject_key", R.request_decision(k % 23 != 0, status, version, F.lit("v1")).alias("d")).select("subject_key", "d.*")


@query(f"""WITH s AS (SELECT dispatch_id, attempt_count, CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 503 END AS code FROM fx_dispatch),
    v AS (SELECT *, CASE WHEN code = 200 THEN 'sent' WHEN code = 404 THEN 'dead' ELSE 'retry' END AS status FROM s)
    SELECT dispatch_id, status, attempt_count + 1 AS attempt_count, CASE WHEN status = 'sent' THEN {NOW} END AS sent_at,
      CASE WHEN status = 'retry' THEN {NOW} + to_seconds(CASE WHEN code = 401 THEN 900 ELSE least(3600, 30 * CAST(pow(2, least(attempt_count, 8)) AS BIGINT)) END) END AS next_attempt_at FROM v""", "fx_dispatch")
def dispatch_step(dispatch: DataFrame) -> DataFrame:
    return _sent(dispatch)


@query("SELECT count(*) AS attempted, count(*) FILTER (WHERE event_id % 6 = 0) AS sent, count(*) FILTER (WHERE event_id % 6 NOT IN (0, 2)) AS retry, count(*) FILTER (WHERE event_id % 6 = 2) AS dead, true AS export_enabled FROM fx_dispatch", "fx_dispatch")
def dispatch_counters(dispatch: DataFrame) -> DataFrame:
    return R.dispatch_counters(_sent(dispatch))


@query(f"SELECT dispatch_id AS outbox_id, CASE WHEN event_id % 3 = 1 THEN {NOW} END AS published_at, attempt_count + CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END AS publish_attempts, CASE WHEN event_id % 3 = 2 THEN 'down' END AS last_error FROM fx_dispatch", "fx_dispatch")
def outbox_publish(dispatch: DataFrame) -> DataFrame:
    none = F.lit(None)
    outbox = dispatch.select(F.col("dispatch_id").alias("outbox_id"), none.cast("timestamp_ntz").alias("published_at"), F.col("attempt_count").alias("publish_attempts"), none.cast("string").alias("last_error"))
    tried = dispatch.where("event_id % 3 > 0").select(F.col("dispatch_id").alias("outbox_id"), (F.col("event_id") % 3 == 1).alias("ok"), F.lit("down").alias("error"))
    return R.outbox_step(outbox, tried, now())


def _eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0 and trim(c_mktsegment) <> ''").select(F.col("c_custkey").alias("user_id"))
    runs = view(spark, sf_dir, "fx_runs")
    filters = runs.select(F.col("run_id").alias("filter_id"), F.split_part("subject_key", F.lit(":"), F.lit(1)).cast("long").alias("user_id"), F.col("requested_at").alias("created_at"))
    return top_filters(users, filters, 100, 20)


QUERIES["eligibility_top_filters"] = _eligibility
ORACLE_SQL["eligibility_top_filters"] = sql("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT run_id AS event_id, CAST(split_part(subject_key, ':', 1) AS BIGINT) AS user_id, requested_at AS ts FROM fx_runs))
    SELECT u.c_custkey AS user_id, f.event_id AS filter_id, f.rn AS rank FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND trim(c_mktsegment) <> '' ORDER BY c_custkey LIMIT 100) u LEFT JOIN f ON f.user_id = u.c_custkey AND f.rn <= 20""", "fx_runs")
